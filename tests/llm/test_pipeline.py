"""The corpus pipeline, stage by stage, against plain Python over whole tables."""

import re

import pytest

import corpus_pipeline
from webloom.llm import labelled, toxicity

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_toxic(docs, labels):
    """Counts, features, fit and scores in one process, on sets of n-grams; only their hash is the engine's."""
    import zlib

    import numpy as np

    grams = {i: set(np.concatenate([np.zeros(0, np.int64), *(h for h, _ in toxicity.ngrams([t.encode()]))]).tolist()) for i, t in docs.items()}
    known = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            known.setdefault(i, set()).add(y)
    train = {i: min(y) for i, y in known.items() if len(y) == 1 and i in docs}
    n1, n0 = sum(train.values()), len(train) - sum(train.values())
    count = {}
    for i, y in train.items():
        for h in grams[i]:
            count.setdefault(h, [0, 0])[y] += 1
    chi = {h: ((p * (n0 - q) - q * (n1 - p)) ** 2 / ((p + q) * (n1 + n0 - p - q + 1)), -h) for h, (q, p) in count.items() if p + q >= toxicity.MIN_DOCS}
    ids = sorted(sorted(chi, key=chi.get, reverse=True)[: toxicity.FEATURES])
    ratio = np.array([np.log((count[h][1] + 1) / (n1 + 1)) - np.log((count[h][0] + 1) / (n0 + 1)) for h in ids])
    has = lambda i: np.array([h in grams[i] for h in ids], float)
    x, y = np.array([has(i) for i in train]), np.array([*train.values()], float)
    w, b = np.ones(len(ids)) * 0.1, np.array([np.log(n1 / n0)])
    adam = labelled.Adam([w, b], 0.05)
    for _ in range(300):
        g = (labelled.sigmoid(x @ (w * ratio) + b) - y) / len(y)
        adam.step([(x.T @ g) * ratio + 1e-4 * w, np.array([g.sum()])])
    return {i: t for i, t in docs.items() if has(i) @ (w * ratio) + b[0] < 0}


def without_shared_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = {}
    for i, t in docs.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in docs.items()}


def one_of_each_class(docs):
    def shingles(t):
        w = WORD.findall(t.translate(LOW))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, up = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in docs if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: t for i, t in docs.items() if find(i) == i}


def plain_tiles(doc, item, seed):
    """Greedy string tiling on lists of words: the longest run that both have unmarked is marked, until none of ``seed`` words is left."""
    in_doc, in_item, n = [False] * len(doc), [False] * len(item), 0
    places = {}
    for i, w in enumerate(doc):
        places.setdefault(w, []).append(i)
    while True:
        best = (0, 0, 0)
        for j, w in enumerate(item):
            for i in places.get(w, []):
                k = 0
                while j + k < len(item) and i + k < len(doc) and item[j + k] == doc[i + k] and not in_item[j + k] and not in_doc[i + k]:
                    k += 1
                best = max(best, (k, -j, -i))
        if best[0] < max(1, seed):
            return n
        k, j, i = best[0], -best[1], -best[2]
        in_item[j : j + k] = in_doc[i : i + k] = [True] * k
        n += k


def without_benchmark(docs, items):
    word = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
    tested = [word.findall(t.translate(LOW)) for t in items]
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = {}
    for i, t in docs.items():
        w = word.findall(t.translate(LOW))
        known = {k: runs(w, k) for k in {min(5, len(x)) for x in tested if x}}
        hit = (x for x in tested if x and runs(x, min(5, len(x))) & known[min(5, len(x))])
        if not any(2 * plain_tiles(w, x, min(5, len(x))) >= len(x) for x in hit):
            out[i] = t
    return out


def test_stages_against_plain_python(spark):
    import tiktoken

    from tests.llm.test_operators import ranks

    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = {i: r.text or "" for i, r in rows.items()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    table, known = spark.read.parquet(f"{SF}/documents.parquet"), docs
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:4], (lambda d: without_toxic(d, [tuple(r) for r in labels.select("doc_id", "toxic").collect()]), without_shared_lines, one_of_each_class, lambda d: without_benchmark(d, items))):
        out = stage(spark, table, SF)
        assert out.columns == table.columns, name
        known = plain(known)
        got = out.collect()
        assert {r.doc_id: r.text or "" for r in got} == known and len(got) == len(known), name
        assert all((r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source) for r in got)
        table = spark.createDataFrame(got, table.schema)
    assert 0 < len(known) < len(docs)
    encoding = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(known) and all(r.same and r.n_tokens == len(r.ids) for r in got)
    assert {r.doc_id: list(r.ids) for r in got} == {i: encoding.encode_ordinary(t) for i, t in known.items()}


def test_stages_of_no_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
