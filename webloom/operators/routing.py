"""Routing of pages to the cheap or the thorough extractor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.config import DEFAULT
from webloom.functions import urls

#: Parts of a URL that call for the thorough extractor, and for the cheap one.
DOCUMENT_WORDS = ("/document", "/paper", "/publication", "/research", "/library")
LISTING_WORDS = ("/sitemap", "/archive", "/category", "/tag", "/index", "/list")


def route_rule(url: Column, size: Column, medium: int = DEFAULT.medium_bytes, large: int = DEFAULT.large_bytes) -> Column:
    """The number of the first rule that holds."""
    low = F.lower(url)
    return (
        F.when(size > large, 1)
        .when(low.rlike("|".join(DOCUMENT_WORDS)), 2)
        .when(urls.query(url) != "", 3)
        .when(size < medium, 4)
        .when(low.rlike("|".join(LISTING_WORDS)), 5)
        .when(F.size(F.split(urls.path(url), "/")) <= 3, 6)
        .otherwise(7)
    )


def routed(pages: DataFrame, medium: int = DEFAULT.medium_bytes, large: int = DEFAULT.large_bytes) -> DataFrame:
    """``pages`` (url, size, ...) with the rule and the route, 'fast' or 'slow'."""
    rule = route_rule(F.col("url"), F.col("size"), medium, large)
    return pages.withColumn("rule", rule).withColumn("route", F.when(F.col("rule").isin(4, 5, 6), "fast").otherwise("slow"))


def route_stats(pages: DataFrame) -> DataFrame:
    """One row: pages by route, and their shares in percent; the slow share is 100 less the fast one."""
    n = routed(pages).agg(F.count_if(F.col("route") == "fast").alias("fast_pages"), F.count_if(F.col("route") == "slow").alias("slow_pages"))
    total = F.col("fast_pages") + F.col("slow_pages")
    fast = F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col("fast_pages") * 100.0 / total, 6))
    return n.withColumn("fast_percent", fast).withColumn("slow_percent", F.round(100.0 - F.col("fast_percent"), 6))
