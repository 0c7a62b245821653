"""Data sources: the mirror's scan and the documents' sink; and streams whose retries wait."""

import json
import os
import random
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from webloom.sources import documents, mirror, stores
from webloom.sources.tables import Folder, read

SF = "/root/testdata/sf0.001"
TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mirror")
    rows = [(i, f"https://H{i % 9}.org/{i}" if i % 10 else "nohost", "x" * 50 + "é" * (i % 40) if i % 7 else None) for i in range(300)] + [(None, "https://h1.org/", "")]
    mirror.mirror(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{folder}", 16)
    return folder, rows


def host(url):
    return url.split("/")[2].lower() if "//" in url else ""


def test_mirror_scan(spark, site):
    folder, rows = site
    for cap in (10, 51, 90, 10**6):
        got = {r.page_id: r for r in mirror.scan(spark, f"file://{folder}", max_body=cap).collect()}
        assert len(got) == len(rows)
        for i, url, html in rows:
            raw = None if html is None else html.encode()
            want = None if raw is None else raw[:cap].decode("utf-8", "replace")
            assert (got[i].host, got[i].url, got[i].html, got[i].size, got[i].cut) == (host(url), url, want, raw and min(len(raw), cap) if raw else (None if raw is None else 0), None if raw is None else len(raw) > cap)
    some = mirror.scan(spark, f"file://{folder}", ["size", "page_id"], max_body=60)
    assert some.columns == ["size", "page_id"] and {(r.page_id, r.size) for r in some.collect()} == {(i, None if h is None else min(60, len(h.encode()))) for i, _, h in rows}
    assert mirror.scan(spark, f"file://{folder}", ["cut"]).count() == len(rows)
    split = mirror.scan(spark, f"file://{folder}", split=1)
    assert split.rdd.getNumPartitions() == len([f for f in stores.files(str(folder)) if f.size]) and split.count() == len(rows)
    assert mirror.scan(spark, f"file://{folder}/none").count() == 0


def test_mirror_filters(spark, site):
    folder, rows = site
    seen = lambda df: sorted((r.page_id for r in df.collect()), key=str)
    want = lambda f: sorted((i for i, u, _ in rows if f(i, host(u))), key=str)
    scan = lambda **how: mirror.scan(spark, f"file://{folder}", ["page_id", "url"], **how)
    some = scan(hosts=["h3.org"])
    assert seen(some) == want(lambda i, h: h == "h3.org") and some.columns == ["page_id", "url"]
    assert seen(scan(hosts=["h3.org", "", "zz"], first=21, last=200)) == want(lambda i, h: h in ("h3.org", "") and i is not None and 20 < i <= 200)
    assert seen(scan(first=290)) == list(range(290, 300)) and seen(scan(last=2)) == [0, 1, 2] and seen(scan(hosts=[])) == [] and seen(scan(hosts=["h1.org"], first=500)) == []
    # One relation in several queries, and two in one.
    every = scan()
    assert every.where("page_id = 7").count() == 1 and every.count() == len(rows) and every.where("page_id IS NULL").count() == 1
    assert some.union(scan(hosts=["h4.org"])).count() == len(want(lambda i, h: h in ("h3.org", "h4.org")))


def test_unwanted_files_are_never_opened(spark, tmp_path):
    mirror.mirror(spark.createDataFrame([(i, f"https://h{i % 9}.org/{i}", "x") for i in range(90)], "page_id long, url string, html string"), f"file://{tmp_path}", 16)
    import zlib

    own = zlib.crc32(b"h4.org") % 16
    for f in stores.files(str(tmp_path)):
        if f"part={own}/" not in f.path:
            open(f.path, "wb").write(b"broken")
    assert mirror.scan(spark, f"file://{tmp_path}", hosts=["h4.org"]).count() == 10
    with pytest.raises(Exception, match="(?i)parquet"):
        mirror.scan(spark, f"file://{tmp_path}").count()


def downloads(spark, rows):
    return spark.createDataFrame(rows, "url string, status int, content binary, at int")


def test_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/docs"
    assert documents.listing(spark, folder).count() == documents.commits(spark, folder).count() == 0
    documents.save(downloads(spark, [("https://a.com/x.pdf", 200, b"1", 2), ("https://b.com/x.pdf", 200, b"22", 1), ("https://c.com/y.pdf", 404, b"", 3), ("https://d.com/z.pdf", 200, None, 4), (None, 200, b"n", 1)]).repartition(3), folder, F.col("at"))
    seen = lambda: {(r.filename, r.url, bytes(r.content)) for r in documents.read(spark, folder).collect()}
    assert seen() == {("x.pdf", "https://a.com/x.pdf", b"1"), ("z.pdf", "https://d.com/z.pdf", b"")}
    documents.save(downloads(spark, [("https://e.com/x.pdf", 200, b"later", 0), ("https://e.com/w.pdf", 200, b"w", 0)]), folder)
    assert seen() == {("x.pdf", "https://e.com/x.pdf", b"later"), ("z.pdf", "https://d.com/z.pdf", b""), ("w.pdf", "https://e.com/w.pdf", b"w")}
    assert sorted((r.number, r.documents, r.bytes) for r in documents.commits(spark, folder).collect()) == [(1, 2, 1), (2, 2, 6)]
    documents.save(downloads(spark, []), folder)
    assert len(seen()) == 3 and documents.commits(spark, folder).count() == 3
    documents.save(downloads(spark, [("https://f.com/v.pdf", 200, b"v", 0)]), folder, overwrite=True)
    assert seen() == {("v.pdf", "https://f.com/v.pdf", b"v")}
    assert not [f for f in stores.files(folder, "staged")]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/docs"
    documents.save(downloads(spark, [("https://a.com/x.pdf", 200, b"1", 2)]), folder)
    bad = F.when(F.col("url").endswith("7.pdf"), F.raise_error(F.lit("broken"))).otherwise(F.col("content"))
    rows = downloads(spark, [(f"https://a.com/{i}.pdf", 200, b"1", 2) for i in range(20)]).repartition(4)
    with pytest.raises(Exception, match="broken"):
        rows.select(F.regexp_extract("url", "[^/]*$", 0).alias("filename"), "url", bad.alias("content")).write.format("webloom_documents").mode("append").save(folder)
    assert [r.filename for r in documents.listing(spark, folder).collect()] == ["x.pdf"] and documents.commits(spark, folder).count() == 1
    assert len(stores.files(folder, "data")) == 1
    time.sleep(2)  # tasks that are being stopped
    documents.tidy(folder)
    assert not stores.files(folder, "staged") and [r.filename for r in documents.listing(spark, folder).collect()] == ["x.pdf"]


def test_a_repeated_task_counts_once(tmp_path):
    """A task that fails once after it has staged half of its files is run again; its first attempt leaves no trace."""
    script = textwrap.dedent(f"""
        import sys; sys.path.insert(0, {TOP!r})
        from pyspark.sql import SparkSession, functions as F
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        from webloom.sources import documents
        spark.dataSource.register(documents.Documents)
        def once(batches):
            from pyspark import TaskContext
            for b in batches:
                for i in range(b.num_rows):
                    if i == 6 and TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
                        raise RuntimeError("lost")
                    yield b.slice(i, 1)
        rows = spark.range(20, numPartitions=2).select(F.format_string("%d.pdf", "id").alias("filename"), F.format_string("https://a.com/%d.pdf", "id").alias("url"), F.lit(b"x").alias("content"))
        rows.mapInArrow(once, "filename string, url string, content binary").write.format("webloom_documents").mode("append").save("file://{tmp_path}/docs")
        print("SEEN", documents.read(spark, "file://{tmp_path}/docs").count())
    """)
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, cwd=TOP)
    assert "SEEN 20" in out.stdout, out.stderr[-2000:]
    (manifest,) = (tmp_path / "docs/commits").iterdir()
    assert json.loads(manifest.read_text())["documents"] == 20
    assert len(stores.files(str(tmp_path / "docs"), "data")) == 20 and not stores.files(str(tmp_path / "docs"), "staged")
