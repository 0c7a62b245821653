"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The letters of ASCII case folding.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """One table of a data folder, narrowed to ``columns`` so that only these are scanned."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is. Pure ASCII takes the cheaper built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, *wanted: str) -> dict[str, str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in wanted:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out[name] = new
    return out


def quoted(name: str) -> str:
    """A column's name for expressions, whatever signs are in it."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, by quoted names."""
    return [F.col(quoted(c)) for c in df.columns]


#: Bits of a sieve, and of each of its pages (what Spark's bitmaps hold).
SIEVE, PAGE = 1 << 25, 1 << 15


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SIEVE))


def _sifted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` with a sieve's page, and whether a row's ``key`` may be among ``keys`` (one column of the same type).

    The sieve is a bitmap of SIEVE bits, whatever the number of keys, so it is broadcast. With very many keys it
    rules out little; that costs speed alone.
    """
    (name,) = keys.columns
    bits = keys.select(_place(F.col(quoted(name))).alias("p")).groupBy(F.floor(F.col("p") / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("p") % PAGE).alias("bits"))
    # Words of four bytes, the first byte the highest; of a byte the first bit is the lowest.
    four = lambda i: F.conv(F.hex(F.substring(F.col("bits"), 4 * i + 1, F.lit(4))), 16, 10).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.lit(PAGE // 32 - 1)), lambda i: (four(i) - F.when(four(i) >= 1 << 31, 1 << 32).otherwise(0)).cast("int"))
    c = fresh(df, "page", "words")
    at = _place(key) % PAGE
    bit = (3 - F.floor(at / 8) % 4) * 8 + at % 8
    out = df.join(F.broadcast(bits.select(F.col("page").alias(c["page"]), words.alias(c["words"]))), F.floor(_place(key) / PAGE) == F.col(c["page"]), "left")
    return out, F.coalesce(F.getbit(F.get(F.col(c["words"]), F.floor(at / 32).cast("int")), bit.cast("int")) == 1, F.lit(False))


def suspects(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among ``keys``: all that are, and few others."""
    out, hit = _sifted(df, key, keys)
    return out.where(hit).select(*columns(df))


def without(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not among ``keys``; a null key is if a null is there. Only suspects are shuffled.

    Both are read twice: ``keys`` should be a table.
    """
    (name,) = keys.columns
    out, hit = _sifted(df, key, keys)
    c = fresh(df, "gone")["gone"]
    gone = keys.select(F.col(quoted(name)).alias(c)).distinct()
    left = out.where(hit).select(*columns(df)).join(gone, key.eqNullSafe(F.col(c)), "left_anti")
    return out.where(~hit).select(*columns(df)).union(left.select(*columns(df)))


#: Has Spark delete a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that cut lineage, in a folder of one call's own below the shared folder of spark.checkpoint.dir.

    A lost executor then costs a reread, not a recomputation. The shuffle files of what is written go at once, as
    nothing runs that plan again; a table goes when ``drop`` says that nothing reads it any more, and what a lazy
    result still reads stays. Where the setting is absent (tests on one machine), a folder below the warehouse is
    used, and set as the session's checkpoint folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not top:
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
            top = spark.sparkContext.getCheckpointDir()
        self.path = f"{top.rstrip('/')}/webloom-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written as table ``name`` and read again."""
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(f"{self.path}/{name}")
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, on whatever store they are."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
