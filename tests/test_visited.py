"""The store of visited URLs: what is new, which buckets are read, and that nothing is shuffled or written again."""

import random
import re

import pytest
from pyspark.sql import functions as F

from webloom.operators import crawl
from webloom.sources import visited


def urls(spark, some):
    return spark.createDataFrame([(x,) for x in some], "url string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("buckets", [1, 7])
def test_against_a_set(spark, buckets):
    rng = random.Random(buckets)
    store, known = visited.Visited(spark, buckets), {}
    for depth in range(5):
        found = {f"http://h{rng.randrange(5)}.org/{rng.randrange(400)}" for _ in range([1, 120, 0, 300, 200][depth])}
        fresh = store.add(urls(spark, found).withColumn("parent", F.lit("p")), depth)
        assert {r.url for r in fresh.collect()} == found - set(known) and store.added == len(found - set(known))
        known |= {u: depth for u in found - set(known)}
    assert {r.url: (r.depth, r.parent) for r in store.reached().collect()} == {u: (d, "p") for u, d in known.items()}
    store.folder.drop("urls", "filters")


def test_a_level_reads_only_suspected_buckets(spark):
    """The plan of a level: no exchange of the visited set, and of its files those of suspected buckets alone."""
    store = visited.Visited(spark, 16)
    store.add(urls(spark, [f"http://a.org/{i}" for i in range(2000)]), 0)
    again = store.folder.bucketed(urls(spark, ["http://a.org/5", "http://a.org/9", *(f"http://new.org/{i}" for i in range(40))]), "asked", "url", 16)
    some = store.suspected(again)
    own = {r[0] for r in again.where("url LIKE '%a.org%'").select(store.bucket()).collect()}
    assert own <= set(some) and len(some) <= 6  # two, and at most a few by chance
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = store.unseen(again)
        assert new.count() == 40
        text = plan(new)
        assert "Exchange" not in text and len(re.findall("LeftAnti", text)) >= 1
        (scan,) = {m for m in re.findall(r"FileScan parquet [^\n]*urls[^\n]*", text) if "bucket" in m}
        listed = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN \(([0-9,]*)\)|= (\d+))", scan)
        assert sorted(map(int, (listed[1] or listed[2]).split(","))) == some
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    files = {f for f in store.urls().where(F.col("bucket").isin(some)).inputFiles()}
    assert {int(re.search(r"/bucket=(\d+)/", f)[1]) for f in files} == set(some)
    # Nothing known is asked for: no bucket is read.
    assert store.unseen(urls(spark, ["http://none.org/1"])).count() == 1


def test_filters(spark):
    """No known URL is ruled out; of unknown ones few are not."""
    store = visited.Visited(spark, 4)
    store.add(urls(spark, [f"u{i}" for i in range(30_000)]), 0)
    assert store.pages[0] == 3
    assert store.suspected(urls(spark, [f"u{i}" for i in range(0, 30_000, 97)])) == [0, 1, 2, 3]
    single = [len(store.suspected(urls(spark, [f"x{i}"]))) for i in range(20)]
    assert sum(single) <= 3
    written = store.filters().collect()
    assert len(written) == 12 and all(len(r.bits) == 4096 for r in written)
    bits = sum(bin(b).count("1") for r in written for b in r.bits)
    assert 100_000 < bits <= 120_000


def test_bodies_are_dealt_once(spark):
    rows = [(i, f"http://h.org/{i}", "<p>", 3) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size long")
    fetch = crawl.from_table(pages, 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fetch(pages.select("url"))
        assert got.count() == 20
        text = plan(got)
        body = text[text.index("SortMergeJoin") :]
        assert body.count("Exchange hashpartitioning(page_id") >= 1 and "hashpartitioning(body" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
