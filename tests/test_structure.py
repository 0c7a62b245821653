"""The structural index against the parser, page by page; one pass over both paths, and what is observed of it."""

import random
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from webloom.operators import extract, structure
from webloom.sources.tables import pages

SF = "/root/testdata/sf0.001"
BITS = ["<", ">", "</", "<!--", "-->", "--", '"', "'", "&", "&amp;", "<a href=", "<a href='/x'>", "</a>", "<script>", "</script>", "<p>", "</li>", "/>", "<br/>", "=", "<!", "<?", "\x00", "\x0b", " ", "<A HREF=/q>", '<p class="x y">', "</ a>", "<title>", "é", "<meta name=description content='x&lt;y'>", "<!doctype html>", "\xa0", "<style>", "</STYLE>", "< ", "<1", "<img src=x/>", "<a href=x>y<a href=z>", "<b></b>", "<hr>", "<script/>", "<nav></nav>", "<title></title>"]


def said(tree):
    return tree.links, tree.title, tree.description, tree.nav


def both(html):
    """(what the parser says, what the index says, whether it was the index)."""
    try:
        want = said(structure.Parsed(html))
    except structure.TooDeep as fault:
        want = str(fault)
    ((tree, fault),) = structure.parsed([html.encode()])
    return want, said(tree) if tree is not None else str(fault), isinstance(tree, structure.Indexed)


def bodies(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]


def test_every_page(spark):
    """The same on all pages, all of them by the index, in at most half of the parser's core time (a margin for noise)."""
    every = [h.encode() for h in bodies(spark)]
    ratios = []
    for _ in range(3):
        began = time.process_time()
        want = [said(structure.Parsed(h.decode())) for h in every]
        half = time.process_time()
        got = [t for a in range(0, len(every), 256) for t, _ in structure.parsed(every[a : a + 256])]
        ratios.append((time.process_time() - half) / (half - began))
    assert all(isinstance(t, structure.Indexed) for t in got) and [said(t) for t in got] == want
    assert min(ratios) < 0.6


def test_mutated_pages(spark):
    rng = random.Random(1)
    some, indexed = bodies(spark)[:400], 0
    for _ in range(5000):
        h = rng.choice(some)[: rng.choice([500, 1500, 3000])]
        for _ in range(rng.randrange(1, 5)):
            i = rng.randrange(len(h))
            h = rng.choice([h[:i] + rng.choice(BITS) + h[i:], h[:i] + h[i + rng.randrange(1, 9) :], h[:i] + rng.choice(BITS) + h[i + rng.randrange(5) :]])
        want, got, by_index = both(h)
        assert got == want, h
        indexed += by_index
    for _ in range(3000):
        want, got, by_index = both("".join(rng.choice(BITS + ["x", "y z", "<li>", "<ul>", "</ul>", "</p>", "<div>", "</div>"]) for _ in range(rng.randrange(12))))
        assert got == want
        indexed += by_index
    assert indexed > 1000


def test_deep_and_empty_pages():
    for html in ("", "x", "<b>" * (structure.NESTING - 1) + "<a href=x>y", "<b>" * (structure.NESTING + 5) + "<p>x</p>", "<b>" * structure.NESTING + "<i>x</i>", "\n", "&amp", "<a href='?a&amp;b'>&lt;</a>&"):
        want, got, _ = both(html)
        assert got == want, html[:40]
    assert [str(f) for _, f in structure.parsed(["<b>".encode() * 600, b"<p>"])] == ["elements nested too deep", "None"]


def test_one_pass(spark):
    """One scan; counts as two queries make them; times of both paths."""
    df = extract.extracted(pages(spark, SF), ("the",), timed=True)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    seen = Observation("seen")
    df.observe(seen, *extract.measures()).write.format("noop").mode("overwrite").save()
    got = seen.get
    fast, slow = df.where("route = 'fast'"), df.where("route = 'slow'")
    assert (got["fast_pages"], got["slow_pages"]) == (fast.count(), slow.count()) and got["fast_pages"] + got["slow_pages"] == 50
    assert got["fast_us"] >= got["fast_pages"] and got["slow_us"] >= got["slow_pages"]
    assert sum(got[f"{r}_links"] for r in ("fast", "slow")) == extract.two_tier_links(pages(spark, SF)).count()
    assert got["slow_docs"] == extract.two_tier_documents(pages(spark, SF), ("the",)).count() and got["fast_docs"] == 0
    plain = {r.page_id: (r.links, r.title) for r in extract.analyzed(pages(spark, SF)).collect()}
    assert all((r.links, r.title) == plain[r.page_id] for r in slow.collect())
    none = spark.createDataFrame([(1, "https://h.com/?x", None, 0), (2, None, "<a href=/x>", 9)], "page_id long, url string, html string, size long")
    assert sorted(r.page_id for r in extract.extracted(none).collect()) == [1, 2] and extract.extracted(none).where("page_id = 1").first().links == []
