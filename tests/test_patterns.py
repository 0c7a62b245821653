"""Many patterns: against plain search, in parts, and at a cost that their number does not set."""

import random
import time

import pytest
from pyspark.sql import functions as F

from webloom.functions import patterns, urls


def plain(text, some, at_end):
    return [n for n, p in enumerate(some) if (text.endswith(p) if at_end else p in text)]


@pytest.mark.parametrize("at_end", [False, True])
def test_against_plain_search(at_end):
    rng = random.Random(3)
    for _ in range(300):
        some = ["".join(rng.choice("abé") for _ in range(rng.randrange(0 if rng.random() < 0.1 else 1, 5))) for _ in range(rng.randrange(1, 12))]
        texts = ["".join(rng.choice("abcé") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        made = patterns.Automaton([(n, p.encode()) for n, p in enumerate(some)])
        assert made.found([t.encode() for t in texts], at_end) == [plain(t, some, at_end) for t in texts], (some, texts)


def test_parts(spark):
    some = [f"p{i}" for i in range(50)] + ["", "x", "x"]
    texts = ["p1p49", None, "", "xp33", "zz"]
    df = spark.createDataFrame([(t, "keep") for t in texts], "t string, patterns2 string")
    assert len(patterns.parts([p.encode() for p in some], 20_000)) > 5 and [n for part in patterns.parts([p.encode() for p in some], 1) for n, _ in part] == list(range(53))
    for limit in (patterns.LIMIT, 20_000):
        for at_end in (False, True):
            got = {r.t: r.patterns for r in patterns.matched(df, F.col("t"), some, at_end, limit=limit).collect()}
            assert got == {t: None if t is None else plain(t, some, at_end) for t in texts}


def test_cost_hangs_on_the_texts():
    """Ten times the patterns take about as long, where plain search takes ten times."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode()
    texts = [b"https://" + word(60) for _ in range(4000)]
    taken = {}
    for n in (200, 2000):
        made = patterns.Automaton([(i, word(8)) for i in range(n)])
        taken[n] = min(_timed(made, texts) for _ in range(3))
    assert taken[2000] < 4 * taken[200]


def _timed(made, texts):
    began = time.process_time()
    made.found(texts)
    return time.process_time() - began


def test_extensions(spark):
    df = spark.createDataFrame([("/a.PDF",), ("/a.pdfx",), ("/a.tar.gz",), ("pdf",), (None,), ("",)], "u string")
    got = [r[0] for r in df.select(urls.is_document_suffix(F.col("u"), [".pdf", ".gz", ".docx"])).collect()]
    assert got == [True, False, True, False, None, False]
    assert [r[0] for r in df.select(urls.is_document_suffix(F.col("u"), [])).collect()] == [False] * 6
