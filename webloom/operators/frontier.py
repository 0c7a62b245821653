"""Depth-bounded expansion of a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.config import DEFAULT
from webloom.sources.tables import Folder
from webloom.sources.visited import Visited


def expand(edges: DataFrame, seeds: DataFrame, max_depth: int | None = DEFAULT.max_depth, buckets: int | None = None) -> DataFrame:
    """(url, depth, parent): every URL that ``seeds`` (url) reach over ``edges`` (src, dst), at its least depth.

    Links of a page at ``max_depth`` are not followed; None follows all. Seeds have depth 0, and are in the result
    once, whether linked or not; ``parent`` is the least page of the level before that links here. The edges are
    dealt to the buckets of the visited URLs once; a level then meets them, and the URLs known before, in place, and
    only what it finds is shuffled.
    """
    known = Visited(edges.sparkSession, buckets)
    folder = Folder(edges.sparkSession, "edges")
    out = folder.bucketed(edges.select("src", "dst").repartition(known.n, "src"), "edges", "src", known.n)
    level = known.add(seeds.select("url").distinct().withColumn("parent", F.lit(None).cast("string")), 0)
    depth = 0
    while known.added and (max_depth is None or depth < max_depth):
        depth += 1
        found = out.join(level.select(F.col("url").alias("src")), "src").groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("parent"))
        level = known.add(found, depth)
    folder.drop("edges")
    return known.reached().select("url", "depth", "parent")


def visited_log(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """URLs that enter the visited log: all reached but seeds that no reached page links back to."""
    back = edges.join(reached.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
    return reached.where("depth > 0").select("url").union(reached.where("depth = 0").select("url").join(back, "url", "left_semi"))
