"""Sources: pages, seeds, interfaces; and the scratch folder that cuts lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.config import DEFAULT
from webloom.functions import urls


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pages(spark: SparkSession, sf_dir: str, max_body: int = DEFAULT.max_body_bytes) -> DataFrame:
    """(page_id, url, html, size): bodies over ``max_body`` bytes are cut, as a fetcher with a cap would."""
    size = F.octet_length("html")
    df = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return df.withColumn("html", F.when(size > max_body, urls.cut_bytes(F.col("html"), max_body)).otherwise(F.col("html"))).withColumn("size", F.octet_length("html").cast("long"))


def seeds(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Valid start URLs at depth 0."""
    return df.select(urls.seed_url(F.col(raw)).alias("url")).where("url IS NOT NULL").withColumn("depth", F.lit(0))


def interfaces(df: DataFrame) -> DataFrame:
    """Network interfaces to use: of (name, ips, is_loopback, is_up, is_running), with the first IPv4 and activity.

    Out are loopback and virtual ones, those without any address, and those that have no IPv4 and are down.
    """
    ip = F.get(F.filter("ips", lambda x: x.rlike(r"^\d+\.\d+\.\d+\.\d+$")), F.lit(0))
    known = df.where(~F.col("is_loopback") & ~F.col("name").contains("vir") & ~F.col("name").contains("docker") & (F.size("ips") > 0))
    return known.withColumn("ip", F.coalesce(ip, F.lit(""))).where((F.col("ip") != "") | F.col("is_up")).withColumn("is_active", F.col("is_up") & F.col("is_running"))


class Folder:
    """Tables of one job in a folder of its own below spark.checkpoint.dir, which all executors share: lineage ends there."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        self.spark, self.key = spark, uuid.uuid4().hex
        self.path = f"{top.rstrip('/')}/{name}-{self.key}"

    def save(self, df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        """Writes ``df`` as table ``name`` and reads it."""
        df.write.mode(mode).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def bucketed(self, df: DataFrame, name: str, key: str, n: int, *parts: str) -> DataFrame:
        """Appends ``df`` to table ``name``, dealt to ``n`` buckets by ``key``: joins on it read the table in place, unshuffled."""
        writer = df.write.mode("append").bucketBy(n, key).option("path", f"{self.path}/{name}")
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(self.table(name))
        return self.spark.table(self.table(name))

    def table(self, name: str) -> str:
        """What the catalog calls a bucketed table."""
        return f"webloom_{self.key}_{name}"

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; without names, all."""
        for name in names or ("",):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table(name)}") if name else None
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below spark.checkpoint.dir and reads it: lineage ends there."""
    return Folder(df.sparkSession, name).save(df, "rows")
