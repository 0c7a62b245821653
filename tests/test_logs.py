"""Logs of streams, what streams report, sketches, the page cache."""

import json

import pytest
from pyspark.sql import functions as F

from webloom.operators import cache, monitor, scheduler
from webloom.sources.tables import Folder, pages
from webloom.streaming import logs, streams

SF = "/root/testdata/sf0.001"


def lines(spark, folder, name, schema):
    return sorted(tuple(r) for r in logs.logged(spark, folder, name, schema).drop("batch").collect())


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/logs"
    rows = lambda a, b: spark.createDataFrame([(f"u{i}", i % 3 > 0) for i in range(a, b)], "url string, ok boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: logs.log(logs.downloads(spark.readStream.schema("url string, ok boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")), folder, "done").awaitTermination()
    rows(0, 10)
    run()
    rows(10, 20)
    run()
    want = sorted((f"u{i}",) for i in range(20) if i % 3)
    assert lines(spark, folder, "done", "url string") == want
    # The last batch is taken for unfinished, as after a crash between its writing and its commit.
    commits = tmp_path / "logs/done/_state/commits"
    last = max((f for f in commits.iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert lines(spark, folder, "done", "url string") == want
    run()
    assert lines(spark, folder, "done", "url string") == want


def test_quiet_logs(spark, tmp_path):
    spark.createDataFrame([(i, f"https://h.org/{i}", "<b>" * 600 if i % 2 else "<a href=/x>") for i in range(50)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/in")
    page = spark.readStream.schema("page_id long, url string, html string").parquet(f"{tmp_path}/in").withColumn("size", F.lit(1).cast("long"))
    folder = f"file://{tmp_path}/logs"
    logs.log(logs.quarantine(page), folder, "bad", most=10).awaitTermination()
    assert lines(spark, folder, "bad", "page_id long, url string, reason string") == [(i, f"https://h.org/{i}", "TooDeep: elements nested too deep") for i in range(1, 20, 2)]
    logs.log(logs.visited(page), folder, "seen").awaitTermination()
    assert lines(spark, folder, "seen", "url string") == [("https://h.org/x",)]
    assert not json.loads((tmp_path / "logs/seen/_state/metadata").read_text())["id"] == ""


def test_progress(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(5, "ts").write.parquet(f"{tmp_path}/events.parquet")
    seen = logs.Progress(spark, f"file://{tmp_path}/log", often=2)
    assert seen.table().count() == 0
    for name, stream in (("a", streams.first_sightings(streams.events(spark, str(tmp_path), 2), "user_id")), ("b", streams.events(spark, str(tmp_path), 1))):
        seen.watch(lambda: logs.log(stream, f"file://{tmp_path}/out", name))
    got = seen.table().where("rows_in > 0").collect()
    assert len({r.stream for r in got}) == 2 and sorted(sum(r.rows_in for r in got if r.stream == s) for s in {r.stream for r in got}) == [1000, 1000]
    assert sorted(len([r for r in got if r.stream == s]) for s in {r.stream for r in got}) == [3, 5]
    assert max(r.state_rows for r in got) == 15 and all(r.ms >= 0 for r in got)
    assert logs.reports(seen.table()).count() == 8 and seen.table().count() == seen.table().count()


def test_sketches(spark):
    links = spark.range(60_000).select((F.col("id") % 3).alias("host"), (F.col("id") % 5).alias("day"), F.concat(F.lit("u"), F.col("id") % 45_000).alias("url"))
    days = monitor.sketches(links, "url", "host", "day")
    assert days.count() == 15 and days.select(F.max(F.octet_length("sketch"))).first()[0] < 20_000
    got = {r.host: r.n_distinct for r in monitor.estimated(monitor.merged(days, "host")).collect()}
    exact = {r.host: r.n for r in links.groupBy("host").agg(F.count_distinct("url").alias("n")).collect()}
    assert all(abs(got[h] - n) <= 3 * 1.04 / 64 * n for h, n in exact.items())
    assert abs(monitor.estimated(monitor.merged(days)).first().n_distinct - 45_000) <= 3 * 1.04 / 64 * 45_000
    assert monitor.estimated(monitor.merged(monitor.sketches(links.limit(0), "url", "host"), "host")).count() == 0


def test_failures_of_queued_tasks(spark):
    rows = [("a", d, s) for d, s in enumerate(["failed", "downloaded", "failed"])] + [("b", 0, "failed"), ("b", 1, "failed")]
    states = scheduler.rediscovered(spark.createDataFrame(rows, "url string, day int, state string"), "day")
    assert {r.url: r.failures for r in monitor.failures(states, "url").collect()} == {"a": 1, "b": 2}
    tries = spark.createDataFrame([(i, i % 2 == 0) for i in range(100)], "t int, ok boolean")
    assert [(r.t, r.line) for r in monitor.first_failures(tries, "t", n=3).orderBy("line").collect()] == [(1, 1), (3, 2), (5, 3)]


def test_page_cache(spark):
    """A second run parses what changed; equal contents are parsed once; null and repeated rows come back."""
    p = pages(spark, SF)
    known = cache.PageCache(spark, 4)
    first = known.analyzed(p)
    assert first.where("parsed").count() == first.count() == 50 == known.missed
    changed = p.withColumn("html", F.when(F.col("page_id") % 10 == 3, F.concat(F.lit("<a href='/more'>"), "html")).otherwise(F.col("html")))
    second = known.analyzed(changed)
    assert known.missed == 5 and {r.page_id for r in second.where("parsed").collect()} == {3, 13, 23, 33, 43}
    plain = {r.page_id: (r.links, r.title, r.failed) for r in __import__("webloom.operators.extract", fromlist=["x"]).analyzed(changed).collect()}
    assert {r.page_id: (r.links, r.title, r.failed) for r in second.collect()} == plain
    again = known.analyzed(changed)
    assert known.missed == 0 and again.where("parsed").count() == 0 and again.count() == 50
    odd = spark.createDataFrame([(1, "https://a.org/", None, 0), (1, "https://a.org/", None, 0), (2, "https://a.org/", "", 0), (None, None, "<a href=/x>", 9), (3, "https://b.org/", "<b>" * 600, 9)], "page_id long, url string, html string, size long")
    got = known.analyzed(odd)
    assert known.missed == 3 and got.count() == 5 and [r.reason for r in got.where("failed").collect()] == ["TooDeep: elements nested too deep"]
    known.drop()
    assert known.analyzed(odd.limit(0)).count() == 0


def test_links_at_the_end_of_a_page(spark):
    from webloom.operators import extract

    cases = {"href=x": [], "href=xy": ["xy"], "href=é": ["é"], "href='": [], "href='x": ["x"], "href=": [], 'a href="href=x': ["href=x"], "href=/a href=x": ["/a"], "href=x ": ["x"], "HREF=x": [], "\nhref=x": [], "href=x\n": ["x\n"]}
    df = spark.createDataFrame([(k,) for k in cases], "html string")
    assert {r.html: r.x for r in df.select("html", extract.raw_links(F.col("html")).alias("x")).collect()} == cases
