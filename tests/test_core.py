"""Edge cases of the crawl engine's expressions and operators."""

import os

import pytest
from pyspark.sql import functions as F

from webloom.functions import figures, urls
from webloom.functions.resolve import resolve
from webloom.operators import crawl, extract, frontier, monitor, network, routing, scheduler, structure
from webloom.plans import registry
from webloom.sources import sinks, tables
from webloom.streaming import streams

SF = "/root/testdata/sf0.001"


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row int, " + schema).orderBy("_row").select(expr).collect()]


def test_make_absolute(spark):
    base = "https://h.com/a/b"
    cases = [("http://x.com/p", "http://x.com/p"), ("http://", base + "/http://"), ("HTTP://x.com", base + "/HTTP://x.com"), ("//c.com/p", "https://c.com/p"), ("//", "https://h.com//"), ("/r", "https://h.com/r"), ("c.html", base + "/c.html"), ("../x", base + "/../x"), ("?q=1", base + "/?q=1"), ("tel:1", base + "/tel:1")]
    assert column(spark, [(r, base) for r, _ in cases], "raw string, base string", urls.make_absolute(F.col("raw"), F.col("base"))) == [x for _, x in cases]


def test_normalize(spark):
    cases = [("https://E.com/Path#s", "https://e.com/path"), ("https://e.com/a?x=1", "https://e.com/a"), ("https://e.com/a/", "https://e.com/a/"), ("https://e.com/für", "https://e.com/f%c3%bcr"), ("https://e.com/a b", "https://e.com/a%20b"), ("https://e.com/%C3%BC", "https://e.com/%c3%bc"), ("https://u@e.com:443", "https://u@e.com:443"), (None, None)]
    got = column(spark, [(a,) for a, _ in cases], "u string", urls.normalize_url(F.col("u")))
    assert got == [b for _, b in cases]
    assert column(spark, [(a,) for a in got], "u string", urls.normalize_url(F.col("u"))) == got


def test_routing(spark):
    cases = [("/x", 512001, 1), ("/x", 512000, 6), ("/Research/x", 10, 2), ("/sitemap?x=1", 10, 3), ("/x#frag", 10, 4), ("/a/b/c/d", 102399, 4), ("/a/b/c/d", 102400, 7), ("/a/b/c/category/x", 102400, 5), ("/a/b", 102400, 6), ("/a/b/", 102400, 7)]
    rows = [("https://e.com" + u, n) for u, n, _ in cases]
    assert column(spark, rows, "url string, size long", routing.route_rule(F.col("url"), F.col("size"))) == [r for *_, r in cases]
    assert routing.route_stats(spark.createDataFrame([], "url string, size long")).first().slow_percent == 100.0


HTML = [
    ('<a HREF="/x">', ["/x"], ["/x"]), ("<a href='/x'>", ["/x"], ["/x"]), ("<a href=/x >", ["/x"], ["/x"]), ('<a href = "/x">', [], ["/x"]), ('<link href="/s.css">', ["/s.css"], []),
    ('<div data-href="/d">', ["/d"], []), ('<!-- <a href="/c"> -->', ["/c"], []), ('<a href="#top">', [], ["https://h.com/p#top"]), ('<a href="#"><a href="">', [], []),
    ('<a href="javascript:f()"><a href="mailto:a@b">', [], []), ('<a href="/q?a=1&amp;b=2">', ["/q?a=1&amp;b=2"], ["/q?a=1&b=2"]), ('<a href="/t', ["/t"], []), ("", [], []),
]


def test_both_extractors(spark):
    pages = spark.createDataFrame([(i, "https://h.com/p", h, len(h)) for i, (h, *_) in enumerate(HTML)], "page_id long, url string, html string, size long")
    fast = {r.page_id: r.x for r in pages.select("page_id", extract.raw_links(F.col("html")).alias("x")).collect()}
    slow = {r.page_id: r.links for r in extract.analyzed(pages).collect()}
    for i, (_, a, b) in enumerate(HTML):
        assert fast[i] == a
        assert [x.replace("https://h.com/", "/") if "#" not in x else x for x in slow[i]] == b


def test_resolve():
    base = "https://h.com/a/b?q=1#f"
    cases = [
        ("c", "https://h.com/a/c"), ("/r", "https://h.com/r"), ("../x", "https://h.com/x"), ("../../x", "https://h.com/x"), ("./", "https://h.com/a/"), ("..", "https://h.com/"), ("/a/../b/./c", "https://h.com/b/c"), ("a/..", "https://h.com/a/"),
        ("", "https://h.com/a/b?q=1#f"), ("#t", "https://h.com/a/b?q=1#t"), ("?z", "https://h.com/a/b?z"), ("?", "https://h.com/a/b?"), ("//c.com/p", "https://c.com/p"), ("//c.com", "https://c.com"),
        ("HTTP://X.com/P", "http://X.com/P"), ("http://x.com/a/../b", "http://x.com/b"), ("tel:1", "tel:1"), ("data:x,y?z#w", "data:x,y?z#w"),
        ("/a b", "https://h.com/a%20b"), ("/für", "https://h.com/f%C3%BCr"), (" /lead ", "https://h.com/a/%20/lead%20"), ("/a%2Fb", "https://h.com/a%2Fb"), ("/a%2Fb c", "https://h.com/a/b%20c"), ("/x?a b", "https://h.com/x?a b"), ("/[x]", "https://h.com/[x]"),
        ("1a:b", None), (":b", None), ("/%zz", None), ("/a#%zz", None), ("a:b/c", "a:b/c"), ("./1a:b", "https://h.com/a/1a:b"), ("/x:y", "https://h.com/x:y"), ("http://a b/", None), ("http://h:x/", None), ("http://h:80/", "http://h:80/"), ("http://u@h/", "http://u@h/"), ("/a\nb", None), ("///x", "https://h.com///x"),
    ]
    for href, want in cases[:-1]:
        assert resolve(base, href) == want, href
    assert resolve("https://h.com", "x") == "https://h.com/x" and resolve("https://h.com", "") == "https://h.com"


def test_quarantine_and_outer_links(spark):
    deep = "<b>" * (structure.NESTING + 5)
    pages = spark.createDataFrame([(1, "https://h.com/?x", deep + '<a href="/a">', 5), (2, "https://h.com/?y", '<a href="/a"><a href="/b">', 5), (3, "https://h.com/z", "none", 5), (4, "https://h.com/z?", None, 0)], "page_id long, url string, html string, size long")
    assert [tuple(r) for r in extract.quarantined(extract.analyzed(pages)).collect()] == [(1, "https://h.com/?x", "TooDeep: elements nested too deep")]
    got = sorted(map(tuple, extract.two_tier_links(pages, outer=True).select("page_id", "route", "pos", "link").collect()), key=str)
    assert got == sorted([(1, "slow", None, None), (2, "slow", 0, "https://h.com/a"), (2, "slow", 1, "https://h.com/b"), (3, "fast", None, None), (4, "fast", None, None)], key=str)
    assert extract.two_tier_links(pages).count() == 2


def test_crawl(spark):
    """Cycles, queries and fragments, a depth limit, and what is not crawlable."""
    site = {"https://h.com/a": ["/B?x=1", "/b#f", "javascript:x", "//other.org/c"], "https://h.com/b": ["/a", "/d"], "https://other.org/c": ["/c/e", "/%zz"], "https://h.com/d": ["/f"], "https://h.com/f": ["/g"]}
    rows = [(i, u, "".join(f'<a href="{x}">' for x in links), 9) for i, (u, links) in enumerate(site.items())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size long")
    fetch = lambda level: level.select("url").join(pages, "url").select("page_id", "url", "html", "size")
    seeds = spark.createDataFrame([("https://h.com/A?s",), ("nohost",)], "url string")
    reach = lambda n: {r.url: r.depth for r in crawl.crawl(seeds, fetch, n).collect()}
    assert reach(0) == {"https://h.com/a": 0}
    assert reach(2) == {"https://h.com/a": 0, "https://h.com/b": 1, "https://other.org/c": 1, "https://h.com/d": 2, "https://other.org/c/e": 2}
    assert reach(9) == reach(2) | {"https://h.com/f": 3, "https://h.com/g": 4}
    assert crawl.crawl(seeds.limit(0), fetch, 3).count() == 0


def test_queues(spark):
    """Pulls and persistent tries against plain queues."""
    n, queue, priority = 3, 12, 5
    tasks = scheduler.numbered(spark.range(40).select(F.format_string("u%02d", "id").alias("url")), "url")
    queues = scheduler.admitted(tasks, n, queue=queue, priority=priority)
    rows = sorted(queues.collect(), key=lambda r: r.seq)
    own = [[r.url for r in rows if r.queue == "iface" and r.iface == i] for i in range(n)]
    first = [r.url for r in rows if r.queue == "priority"]
    want, turn = {}, 0
    while first or any(own):
        for i in range(n):
            q = first or own[i]
            if q:
                want[q.pop(0)] = (i, turn)
        turn += 1
    got = {r.url: (r.puller, r.turn) for r in scheduler.pulled(queues, n, queue=queue).collect()}
    assert got == want and len(got) == 17
    assert tuple(scheduler.queue_totals(queues, n, queue, priority).first()) == (17, 17)
    over = queues.where("queue = 'overflow'").select("url", (F.col("seq") - 17).alias("rank"))
    kept = {r.url: (r.attempt, r.queue, r.waited_ms) for r in scheduler.persistent(over, n, 2, 1, tries=4, backoff_ms=50).collect()}
    waiting, want = [r.url for r in rows if r.queue == "overflow"], {}
    waited = 0
    for attempt in range(4):
        waited += 50 * attempt
        for place in ["priority"] * 2 + [f"iface {i}" for i in range(n)]:
            if waiting:
                want[waiting.pop(0)] = (attempt, place, waited)
    assert kept == want | {u: (None, "dropped", waited) for u in waiting} and waiting
    assert [r.wait_us for r in scheduler.rate_limited(tasks, 1000, 38).orderBy("seq").collect()][-3:] == [0, 1000, 2000]
    names = spark.createDataFrame([(i, f"nic{i}") for i in range(4)], "iface int, name string")
    assert {r.name for r in scheduler.with_interfaces(queues, names, "name").collect()} == {"nic0", "nic1", "nic2"}
    report = {r.iface: (r.queued, r.capacity, r.percent) for r in monitor.interface_queues(names.withColumn("speed", F.lit("x")), queues, queue, n).collect()}
    assert report == {0: (4, 4, 100.0), 1: (4, 4, 100.0), 2: (4, 4, 100.0), 3: (0, 4, 0.0)}


def test_states_of_tasks(spark):
    rows = [("a", d, s) for d, s in enumerate(["failed", "failed", "downloaded", "failed"])] + [("b", 0, "pending"), ("b", 1, "failed"), ("c", 0, "failed")]
    states = spark.createDataFrame(rows, "url string, day int, state string")
    assert {(r.url, r.day): r.enqueued for r in scheduler.rediscovered(states, "day").collect()} == {("a", 0): True, ("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 0): True, ("b", 1): False, ("c", 0): True}
    assert {r.url: r.failures for r in monitor.failures(states, "url").collect()} == {"a": 3, "b": 1, "c": 1}


def test_running_counters(spark):
    made = scheduler.numbered(spark.range(257).select("id", (F.col("id") % 3 != 0).alias("ok")), "id")
    want = [(n, n - len(range(0, n, 3)), len(range(0, n, 3))) for n in range(10, 258, 10)]
    for coarse in (1, 4, 10_000):
        assert sorted(map(tuple, monitor.every(made, 10, coarse=coarse).collect())) == want
    assert [r.line for r in monitor.first_lines(made.withColumn("k", F.lit(1)), "k", "id", n=3).collect()] == [1, 2, 3]
    ticks = spark.createDataFrame([(i, q, 100) for i, q in enumerate([10, 50, 70, 90, 10])], "t int, queued int, capacity int")
    assert [r.workers for r in monitor.scale_ticks(ticks, "t").orderBy("t").collect()] == [100, 400, 800, 800, 800]


def test_depth(spark):
    assert column(spark, [("3",), ("12ab",), (" 7",), ("-1",), ("x",), ("",), (None,), ("99999999999",)], "d string", urls.depth(F.col("d"))) == [3, 12, 7, -1, 0, 0, 0, 0]


def test_interface_source(spark):
    rows = [("eth0", ["fe80::1", "10.0.0.5"], False, True, True), ("lo", ["127.0.0.1"], True, True, True), ("e1", [], False, True, True), ("e2", ["fe80::2"], False, True, False), ("e3", ["fe80::3"], False, False, False), ("virbr0", ["1.2.3.4"], False, True, True)]
    got = tables.interfaces(spark.createDataFrame(rows, "name string, ips array<string>, is_loopback boolean, is_up boolean, is_running boolean"))
    assert [(r.name, r.ip, r.is_active) for r in got.collect()] == [("eth0", "10.0.0.5", True), ("e2", "", False)]


def test_documents_and_metadata(spark):
    html = "<title>A &amp; B</title><meta name='description' content='d'><nav></nav><p>See <a href='f.PDF'>the <b>file</b></a> of " + "ü" * 200 + "<p><a href='x.pdf?v=1'>q</a>"
    pages = spark.createDataFrame([(1, "https://h.com/a/b", html, len(html.encode())), (2, "https://h.com/", None, 0)], "page_id long, url string, html string, size long")
    (doc,) = extract.documents(pages).collect()
    assert (doc.url, doc.extension, doc.title) == ("https://h.com/a/f.PDF", ".PDF", "the file") and doc.context.endswith("...")
    assert extract.documents(pages, contains=True).count() == 2
    meta = {r.page_id: r for r in extract.metadata(pages).collect()}
    assert (meta[1].title, meta[1].description, meta[1].has_nav, meta[1].link_count) == ("A & B", "d", True, 2)
    assert (meta[2].title, meta[2].link_density) == ("", 0.0)


def test_metadata_of_cut_references(spark, tmp_path):
    """Titles that end inside a reference, or hold others than SQL's: the query agrees with its SQL; the operator alone reads them as HTML."""
    import duckdb

    titles = ["x&amp;&amp", "x&am", "x&", "&quot;x&quot", "&lt;b&gt &lt", "&amp;lt; &amp;amp", "&copy;&copy &#39; &AMP; &notit;", "plain", ""]
    rows = [(i, f"https://h.com/research/{i}", f"<title>{t}</title><nav><a href='/q?a=1&copy=2&amp;b'>x &amp</a></nav>") for i, t in enumerate(titles)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.page_metadata(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.execute(registry.SQL["page_metadata"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == len(titles)
    html = {r.page_id: r.title for r in extract.metadata(pages.withColumn("size", F.octet_length("html").cast("long"))).collect()}
    assert html[0] == "x&&" and html[6] == "©© ' & ¬it;"
    kept = pages.select(extract.closed_references(F.col("html"), ("amp",)).alias("h")).where("h LIKE '%?a=1&amp;copy=2&amp;b%'")
    assert kept.count() == len(titles)


def test_file_names(spark):
    cases = [("/d/a.pdf?x=1", None, "a.pdf"), ("/d/a.pdf", 'attachment; filename="r:1.pdf"', "r_1.pdf"), ("/d/z.pdf", "inline; filename=y.pdf", "z.pdf"), ("/" + "n" * 250 + ".pdf", None, "n" * 196 + ".pdf")]
    assert column(spark, [(u, d) for u, d, _ in cases], "u string, d string", urls.filename(F.col("u"), F.col("d"))) == [x for *_, x in cases]
    assert column(spark, [("/d/",), ("/d/noext",)], "u string", urls.filename(F.col("u")).startswith("download_")) == [True, True]


def test_extension_and_detection(spark):
    rows = [("/a.PDF",), ("/a.pdf?v=1",), ("/a.pdf#p2",), ("/x?f=a.pdf&y=1",), ("/a.pdfx",), ("/a",)]
    assert column(spark, rows, "u string", urls.extension(F.col("u"))) == [".PDF", ".pdf", ".pdf#p2", ".pdf&y=1", ".pdfx", ""]
    assert column(spark, rows, "u string", urls.is_document_suffix(F.col("u"), [".pdf"])) == [True, False, False, False, False, False]
    assert column(spark, rows, "u string", urls.is_document_contains(F.col("u"), [".pdf"])) == [True, True, False, True, False, False]


def test_seeds(spark):
    got = tables.seeds(spark.createDataFrame([("https://a.com/",), ("ftp://b.com/x",), ("nohost",), ("/p",), (None,)], "raw string"))
    assert sorted(r.url for r in got.collect()) == ["https://a.com/", "https://b.com/x"]


def test_frontier(spark):
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(16)] + [("c0", "d1"), ("d1", "c2"), ("c3", "c0"), ("c1", "c1")], "src string, dst string")
    got = {r.url: r.depth for r in frontier.expand(edges, spark.createDataFrame([("c0",)], "url string")).collect()}
    assert got["c2"] == 2 and got["c0"] == 0 and max(got.values()) == 13 and "c14" not in got
    reached = frontier.expand(edges, spark.createDataFrame([("c0",)], "url string"), None)
    assert reached.count() == 18
    assert "c0" in {r.url for r in frontier.visited_log(reached, edges).collect()}


def test_scheduler(spark):
    tasks = scheduler.numbered(spark.range(50).select(F.format_string("u%02d", "id").alias("url")), "url")
    got = scheduler.admitted(tasks, 3, queue=30, priority=5).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, 51)) and got[0].iface == 1
    assert [r.queue for r in got].count("iface") == 30 and [r.queue for r in got].count("priority") == 5
    made = scheduler.tries(spark.createDataFrame([("a", 1, True), ("b", 1, False), ("b", 2, True), ("b", 3, True)] + [("c", i, False) for i in range(6)], "url string, ts int, ok boolean"), "url")
    states = {r.url: (r.attempts, r.failures, r.state) for r in scheduler.final_states(made, "url").collect()}
    assert states == {"a": (1, 0, "downloaded"), "b": (2, 1, "downloaded"), "c": (4, 4, "failed")}
    assert made.where("url = 'c'").agg(F.sum("backoff_ms")).first()[0] == 1800


def test_scaling(spark):
    cases = [(40, 100, 100, 0), (41, 100, 100, 300), (60, 100, 100, 300), (61, 100, 100, 600), (81, 100, 100, 700), (90, 100, 800, 0), (1, 0, 1, 0)]
    assert column(spark, [c[:3] for c in cases], "q int, c int, w int", monitor.scale_up(F.col("q"), F.col("c"), F.col("w"))) == [c[3] for c in cases]
    assert column(spark, [(1023,), (1024,), (3328,), (5 * 1024**3,)], "n long", figures.format_bytes(F.col("n"))) == ["1023 B", "1.0 KB", "3.2 KB", "5.0 GB"]
    nics = spark.createDataFrame([("a", 10000), ("b", 100000), ("c", 2500), ("enp3s0f1", None), ("wg0", None)], "name string, speed_mbps int")
    assert [r.worker_count for r in network.configured(nics).collect()] == [2000, 200, 200, 2000, 200]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("https://a.com/x.pdf", 200, b"1"), ("https://b.com/x.pdf", 200, b"2"), ("https://c.com/y.pdf", 404, b"")], "url string, status int, content binary")
    sinks.write_documents(df, str(tmp_path / "docs"))
    out = spark.read.parquet(str(tmp_path / "docs"))
    assert out.count() == 2 and sinks.collisions(out).first().n_urls == 2
    sinks.append_log(df, "url", str(tmp_path / "log"))
    sinks.append_log(df, "url", str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 6


def test_document_files(spark, tmp_path):
    """Equal names overwrite each other, in order; a second run leaves the same files."""
    df = spark.createDataFrame([("https://a.com/x.pdf", 200, b"1", 2), ("https://b.com/x.pdf", 200, b"22", 1), ("https://c.com/y.pdf", 404, b"", 3), ("https://d.com/z.pdf", 200, None, 4)], "url string, status int, content binary, at int")
    folder = tmp_path / "files"
    for _ in range(2):
        got = {tuple(r) for r in sinks.write_files(df, f"file://{folder}", F.col("at")).collect()}
        assert got == {("x.pdf", "https://a.com/x.pdf", 1), ("z.pdf", "https://d.com/z.pdf", 0)}
        assert {f.name: f.read_bytes() for f in folder.iterdir()} == {"x.pdf": b"1", "z.pdf": b""}
    sinks.write_files(df, f"file://{folder}").collect()
    assert (folder / "x.pdf").read_bytes() == b"22"


def test_stream_retries(spark, tmp_path):
    spark.createDataFrame([("a", False), ("a", False), ("a", False), ("a", False), ("b", True)], "url string, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, ok boolean").parquet(str(tmp_path / "in"))
    got = {(r.url, r.attempts, r.state) for r in streams.drained(streams.retry_states(stream)).collect()}
    assert got == {("a", 4, "failed"), ("b", 1, "downloaded")}


def test_streams_resume_and_late_data(spark, tmp_path):
    """A second run goes on from the first one's state; data later than the delay are left out."""
    place, folder = str(tmp_path / "run"), str(tmp_path / "in")
    spark.createDataFrame([("a", False), ("a", False), ("b", True)], "url string, ok boolean").coalesce(1).write.mode("append").parquet(folder)
    source = lambda: spark.readStream.schema("url string, ok boolean").parquet(folder)
    assert {tuple(r) for r in streams.drained(streams.retry_states(source()), path=place).collect()} == {("b", 1, "downloaded")}
    spark.createDataFrame([("a", False), ("a", False), ("a", True)], "url string, ok boolean").coalesce(1).write.mode("append").parquet(folder)
    assert {tuple(r) for r in streams.drained(streams.retry_states(source()), path=place).collect()} == {("b", 1, "downloaded"), ("a", 4, "failed"), ("a", 1, "downloaded")}

    folder = str(tmp_path / "late")
    for day, hour in ((1, 1), (5, 1), (5, 1), (1, 2), (9, 1)):  # what is late is told by the batch before the last
        spark.sql(f"SELECT timestamp'2024-01-0{day} 0{hour}:00:00' AS ts, true AS ok, 'k{day}' AS key").coalesce(1).write.mode("append").parquet(folder)
    order = sorted((tmp_path / "late").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    for i, f in enumerate(order):  # a stream takes files by their time
        os.utime(f, (1_700_000_000 + 10 * i,) * 2)
    late = spark.readStream.schema("ts timestamp, ok boolean, key string").option("maxFilesPerTrigger", 1).parquet(folder)
    counts = {r.start.day: r.attempts for r in streams.drained(streams.window_counts(late)).collect()}
    assert counts[1] == 1 and counts[5] == 2  # the second sighting of day 1 comes after day 5 and is late
    assert sorted(r.key for r in streams.drained(streams.first_sightings_within(late, "ts", "1 hour", "key")).collect()) == ["k1", "k5", "k9"]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("pages", "events", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    other = con.sql(registry.SQL[name])
    assert sorted(other.columns) == columns
    assert mine == sorted(repr(r) for r in other.project(", ".join(columns)).fetchall())
