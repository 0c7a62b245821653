"""The crawl as a loop of set operations: fetch a level, extract, normalize, drop what is known, go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.config import DEFAULT
from webloom.functions import urls
from webloom.operators import extract
from webloom.sources.tables import Folder
from webloom.sources.visited import Visited

Fetch = Callable[[DataFrame], DataFrame]


def crawl(seeds: DataFrame, fetch: Fetch, max_depth: int = DEFAULT.max_depth, buckets: int | None = None) -> DataFrame:
    """(url, depth): every normalized URL that ``seeds`` (url) reach, at its least depth; seeds at 0.

    ``fetch`` gives the pages (page_id, url, html, size) of a level's URLs. Pages of ``max_depth`` are not followed,
    hence not fetched. Each level is one pass over its pages; its cost follows the level, as the URLs known before
    are neither shuffled nor written again (see ``Visited``).
    """
    known = Visited(seeds.sparkSession, buckets)
    level = known.add(seeds.where(urls.is_crawlable(F.col("url"))).select(urls.normalize_url(F.col("url")).alias("url")).distinct(), 0)
    for depth in range(1, max_depth + 1):
        if not known.added:
            break
        level = known.add(extract.new_urls(extract.two_tier_links(fetch(level))).withColumnRenamed("norm_url", "url"), depth)
    return known.reached().select("url", "depth")


def served(url: Column, n: int) -> Column:
    """Which of n pages, numbered from 0, a URL shows in a site made of a table whose pages link to none of it."""
    return (F.conv(F.substring(F.md5(url.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("long")


def from_table(pages: DataFrame, buckets: int | None = None) -> Fetch:
    """Fetches from a table of pages (page_id, url, html, size), numbered from 0 without gaps, by ``served``.

    The bodies are dealt to buckets by page once; a level's URLs go to them, and no body is shuffled again.
    """
    spark = pages.sparkSession
    n = pages.count()
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bodies = pages.select(F.col("page_id").alias("body"), "html", "size").repartition(buckets, "body")
    bodies = Folder(spark, "bodies").bucketed(bodies, "bodies", "body", buckets)

    def fetch(level: DataFrame) -> DataFrame:
        asked = level.select("url", served(F.col("url"), n).alias("page_id"))
        return asked.join(bodies.hint("merge"), asked["page_id"] == bodies["body"]).select("page_id", "url", "html", "size")

    return fetch
