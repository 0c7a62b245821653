"""Results of the thorough path by content: a page is parsed again only when its URL or its body has changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.config import DEFAULT
from webloom.operators import extract
from webloom.sources.tables import Folder

_KEEP = ["links", "documents", "title", "description", "has_nav", "reason", "us"]


def content_key(url: Column, html: Column) -> Column:
    """What a result is kept under: the SHA-256 of the URL and the body, told apart by the URL's length."""
    u, h = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    return F.sha2(F.concat(F.octet_length(u).cast("string"), F.lit(":"), u, h), 256)


class PageCache:
    """Results in buckets by key, appended run by run; a run's keys meet them in place. ``missed``: contents parsed in the last run."""

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark, self.folder = spark, Folder(spark, "page-cache")
        self.n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs, self.missed = 0, 0

    def analyzed(self, pages: DataFrame, extensions: Sequence[str] = DEFAULT.extensions) -> DataFrame:
        """As ``extract.analyzed`` of pages (page_id, url, html, size), with ``parsed``: whether it was parsed in this run.

        Bodies are read once to be hashed, and those that are not known once more; equal ones are parsed once. Keys
        are shuffled; bodies only where more are missing than Spark broadcasts keys of. Results of other extensions
        belong in another cache.
        """
        self.runs += 1
        named = pages.withColumn("key", content_key(F.col("url"), F.col("html")))
        keys = self.folder.bucketed(named.select("page_id", "url", "size", "key").repartition(self.n, "key"), f"keys{self.runs}", "key", self.n)
        wanted = keys.select("key").distinct()
        if self.runs > 1:
            wanted = wanted.join(self.results().select("key"), "key", "left_anti")
        missing = self.folder.save(wanted, f"missing{self.runs}")
        self.missed = missing.count()
        if self.missed or self.runs == 1:
            once = named.join(missing, "key", "left_semi").dropDuplicates(["key"])
            made = extract.analyzed(once, extensions, keep=("key",)).select("key", *_KEEP, F.lit(self.runs).alias("run"))
            self.folder.bucketed(made.repartition(self.n, "key"), "results", "key", self.n)
        self.folder.drop(f"missing{self.runs}")
        every = keys.join(self.results(), "key")
        return every.select("page_id", "url", "size", *_KEEP, F.col("reason").isNotNull().alias("failed"), (F.col("run") == self.runs).alias("parsed"))

    def results(self) -> DataFrame:
        """All results, by key."""
        return self.spark.table(self.folder.table("results"))

    def drop(self) -> None:
        """Forgets everything."""
        self.folder.drop("results", *(f"keys{n}" for n in range(1, self.runs + 1)))
        self.runs = 0
