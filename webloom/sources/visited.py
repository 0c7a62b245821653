"""The URLs that a crawl has reached: a table in buckets by URL, appended to level by level, under Bloom filters.

A level's finds are dealt to the same buckets, so that they meet the table without a shuffle of it. Each level leaves
a filter of fixed false-positive rate for each bucket; buckets in which no find may be known are not read at all.
Nothing that is there is written again.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.tables import Folder

#: Bits of a filter for each URL (false positives below one in a hundred), probes, and bits of a page (what Spark's bitmaps hold).
BITS, PROBES, PAGE = 12, 4, 32768


def _probes(key: Column) -> list[Column]:
    """The bits that a URL has in its page of a filter."""
    mixed = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(mixed, 15 * k).bitwiseAND(F.lit(PAGE - 1)).cast("long") for k in range(PROBES)]


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


class Visited:
    """URLs with the depth at which they were first found, and any columns found with them.

    ``buckets`` is by default the number of shuffle partitions: what a shuffle by URL yields is then dealt already.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark, self.folder = spark, Folder(spark, "visited")
        self.n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.pages: dict[int, int] = {}  # of each level's filters, how many a bucket has
        self.added = 0  # rows of the last level

    def bucket(self) -> Column:
        """The bucket of a URL, as Spark numbers it."""
        return F.pmod(F.hash("url"), F.lit(self.n))

    def add(self, found: DataFrame, depth: int) -> DataFrame:
        """Adds the rows of ``found`` (distinct url, ...) that are not yet known, as those of ``depth``; returns these."""
        name = f"found{depth}"
        found = self.folder.bucketed(found, name, "url", self.n)
        new = self.unseen(found).withColumn("depth", F.lit(depth)).withColumn("bucket", self.bucket())
        self.folder.bucketed(new, "urls", "url", self.n, "depth", "bucket")
        self.folder.drop(name)
        level = self.level(depth)
        self.added = level.count()  # from the footers
        if self.added:
            self._filter(level, depth, ceil(self.added * BITS / PAGE / self.n))
        return level

    def unseen(self, found: DataFrame) -> DataFrame:
        """The rows of ``found`` whose URL is not known. Reads the buckets that the filters do not rule out, unshuffled."""
        some = self.suspected(found)
        if not some:
            return found
        return found.join(self.urls().where(F.col("bucket").isin(some)).select("url"), "url", "left_anti")

    def suspected(self, found: DataFrame) -> list[int]:
        """The buckets that may hold a URL of ``found``: ``buckets`` numbers at most."""
        if not self.pages:
            return []
        levels = F.array(*(F.struct(F.lit(d).alias("level"), F.lit(p).alias("pages")) for d, p in self.pages.items()))
        asked = found.select(self.bucket().alias("bucket"), F.xxhash64("url").alias("h"), *(p.alias(f"p{k}") for k, p in enumerate(_probes(F.col("url")))), F.explode(levels).alias("l"))
        asked = asked.select("bucket", *(f"p{k}" for k in range(PROBES)), F.col("l.level").alias("level"), F.pmod("h", "l.pages").alias("page"))
        hit = F.lit(True)
        for k in range(PROBES):
            hit = hit & _bit(F.col("bits"), F.col(f"p{k}"))
        return sorted(r[0] for r in asked.join(self.filters(), ["level", "bucket", "page"]).where(hit).select("bucket").distinct().collect())

    def _filter(self, level: DataFrame, depth: int, pages: int) -> None:
        each = level.select(self.bucket().alias("bucket"), F.pmod(F.xxhash64("url"), F.lit(pages)).alias("page"), F.explode(F.array(*_probes(F.col("url")))).alias("bit"))
        bits = each.groupBy("bucket", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))
        self.folder.save(bits.withColumn("level", F.lit(depth)), "filters", "append")
        self.pages[depth] = pages

    def filters(self) -> DataFrame:
        """(bucket, page, bits, level): some 12 bits for each URL."""
        return self.spark.read.schema("bucket int, page long, bits binary, level int").parquet(f"{self.folder.path}/filters")

    def urls(self) -> DataFrame:
        """All rows, with depth and bucket."""
        return self.spark.table(self.folder.table("urls"))

    def level(self, depth: int) -> DataFrame:
        """The rows first found at ``depth``, read alone, without the bucket."""
        return self.urls().where(F.col("depth") == depth).drop("bucket")

    def reached(self) -> DataFrame:
        """All rows, with their depth."""
        return self.urls().drop("bucket")
