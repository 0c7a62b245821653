"""Fill-in-middle, hard negatives and WARC archives against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import AWKWARD, sha, table
from webloom.llm import fill_in_middle, hard_negatives, queries, warc

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_runs_against_lists_of_units(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(fill_in_middle, "SLICE", 20)
    for _ in range(400):
        texts = ["".join(rng.choice("ab é日🙂 \n\t") for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 6))]
        for unit in ("word", "char"):
            runs = fill_in_middle.Runs([t.encode() for t in texts], unit)
            units = [TOKEN.findall(t) if unit == "word" else list(t) for t in texts]
            assert runs.counts().tolist() == [len(x) for x in units]
            k = np.array([rng.randrange(len(x) + 1) for x in units])
            at, chars = runs.cut(k)
            assert [(a, c) for a, c in zip(at, chars)] == [(len("".join(x[:n]).encode()), len("".join(x[:n]))) for x, n in zip(units, k)]
        assert [x for a, b in fill_in_middle._slices([t.encode() for t in texts]) for x in texts[a:b]] == texts


def plain_fim(doc_id, text, units, rate=50, spm_rate=80):
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    t = units(text)
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(t), "plain", None, None, text
    spm = h[3] % 100 < spm_rate
    return len(t), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["word", "char"])
def test_fill_in_middle(spark, unit):
    rng = random.Random(4)
    rows = [*AWKWARD, *((i, "".join(rng.choice("ab <PSM>é日🙂 \n\t") for _ in range(rng.randrange(60)))) for i in range(100, 300)), *((i, f"a <{'PSM'[i % 3]}> b") for i in range(300, 312)), (320, "x < P> <S"), (321, "end<P")]
    docs = table(spark, rows).withColumn("output", F.lit("mine")).withColumn("a.b", F.lit("dot"))
    units = TOKEN.findall if unit == "word" else list
    for rate, spm in ((50, 80), (100, 0), (100, 100), (0, 50)):
        made = fill_in_middle.fill_in_middle(docs, unit=unit, rate=rate, spm_rate=spm)
        assert made.columns == ["doc_id", "text", "id", "h", "node", "words", "_id", "label", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == plain_fim(r.doc_id, r.text or "", units, rate, spm), r.doc_id
            assert r.back == (r.text or "") and r.label == "keep" and r["a.b"] == "dot"
    assert fill_in_middle.fill_in_middle(table(spark, [])).count() == 0
    odd = spark.createDataFrame([("k", "one two")], "`doc.id` string, `my.text` string")
    (r,) = fill_in_middle.fill_in_middle(odd, "doc.id", "my.text", marks=("[p]", "[s]", "[m]"), rate=100).collect()
    assert sorted(re.split(r"\[[psm]\]", r.output)[1:]) == sorted(x for x in ["", "", "one two"] if x is not None) or "one" in r.output
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(odd, marks=("x", "x", "y"))


def plain_negatives(rows, every, scale=256, positives=5, negatives=10):
    """By sorting all rows for each anchor, in whole numbers."""
    import math

    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    best = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [cut(math.floor(float(np.float32(c)) * scale)) for c in v]
        best[i] = min(best.get(i, (y, x)), (y, x))
    out = []
    for a, (label, q) in best.items():
        if a % every:
            continue
        score = {i: cut(sum(s * t for s, t in zip(q, x))) for i, (_, x) in best.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label][:positives]:
            fits = [i for i in order if best[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:negatives]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every):
    df = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id long, embedding array<float>, label int, anchor string")
    got = hard_negatives.hard_negatives(df.repartition(3), F.col("vec_id") % every == 0)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


@pytest.mark.parametrize("small", [True, False])
def test_hard_negatives(spark, monkeypatch, small):
    """Clusters, where intervals leave segments out; a third of equal vectors; null, broken, short and repeated rows."""
    if small:
        for name, value in (("SEGMENT", 5), ("BLOCK", 3), ("AT_ONCE", 2), ("HELD", 1), ("PIVOTS", 4)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, (centres[i % 6] * (1 + i % 2) + rng.normal(0, 0.15, 8)).tolist(), int(rng.integers(0, 4))) for i in range(240)]
    rows += [(i, [0.5] * 8, i % 3) for i in range(240, 360)]
    rows += [(400, None, 1), (401, [0.5] * 7 + [None], 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] * 8, 1), (404, [0.5] * 8, None), (None, [0.5] * 8, 1), (405, [0.5, 0.5], 1), (406, [], 1), (410, [0.0] * 8, 2), (420, [-0.5] * 8, 7)]
    rows += rows[:20] + [(30, [1.0] * 8, 3), (40, rows[40][1], 0), (-10, rows[3][1], 1)]
    want = plain_negatives(rows, 10)
    assert len(want) > 200 and mined(spark, rows, 10) == want


def test_hard_negatives_skip_segments(spark, monkeypatch):
    """Far clusters are not scanned: a block meets few of the segments."""
    for name, value in (("SEGMENT", 16), ("BLOCK", 4), ("PIVOTS", 12)):
        monkeypatch.setattr(hard_negatives, name, value)
    met = []
    save = hard_negatives.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        met.append((name, out.count())) if "units" in name or name in ("segments", "blocks") else None
        return out

    monkeypatch.setattr(hard_negatives.Scratch, "save", counted)
    rng = np.random.default_rng(5)
    centres = np.eye(12)
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.01, 12)).tolist(), (i // 12) % 2) for i in range(960)]
    assert mined(spark, rows, 40) == plain_negatives(rows, 40)
    n = dict(met)
    assert sum(v for k, v in met if k.startswith("positives-units")) < 0.5 * n["segments"] * n["blocks"]


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark, [], 10) == [] and mined(spark, [(10, [1.0], 1)], 10) == [] and mined(spark, [(11, [1.0], 1)], 10) == []
    assert mined(spark, [(10, [1.0], 1), (11, [1.0], 1), (12, [0.5], 0)], 10) == [(10, 11, 1, 12, 65536, 32768)]
    # Beyond what floating point holds exactly, and beyond 64 bits.
    rng = random.Random(3)
    large = [(i, [rng.uniform(-1, 1) * 10.0 ** (5 + i % 3) for _ in range(4)], i % 2) for i in range(40)]
    assert mined(spark, large, 4) == plain_negatives(large, 4) != []
    huge = [(i, [3e38 * (1 - 2 * (i % 3 == 2)), 1e30], i % 2) for i in range(12)]
    assert mined(spark, huge, 4) == plain_negatives(huge, 4)


def made(n, zipped, seed=0):
    """Records of an archive: (bytes, id, payload)."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        payload = "".join(rng.choice("ab\r\n<é WARC/1.1") for _ in range(rng.choice([0, 5, 300, 2000]))).encode()
        kind = "revisit" if i % 5 == 4 else "response"
        raw = warc.record(kind, f"<urn:r:{seed}-{i}>", f"http://h/{i}", "2024-01-01T00:00:00Z", sha(payload), payload, len(payload), {"Page-Id": str(i)})
        out.append((warc.member(raw) if zipped else raw, f"<urn:r:{seed}-{i}>", None if kind == "revisit" else payload))
    return out


def scan(raw):
    rows = list(warc.salvaged(warc.Window(lambda n, at: raw[at : at + n], len(raw))))
    at = 0
    for start, end, *_ in rows:  # all bytes are accounted for
        assert start == at and end > start
        at = end
    assert at == len(raw)
    return rows


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(monkeypatch, zipped):
    """Whole records survive whatever happens to others; gaps are what lies between."""
    monkeypatch.setattr(warc, "BLOCK", 700)
    rng = random.Random(6)
    for seed in range(120):
        whole = made(12, zipped, seed)
        assert [(r[2]["warc-record-id"], r[3]) for r in scan(b"".join(x for x, *_ in whole))] == [(i, p) for _, i, p in whole]
        parts, want = [], []
        for raw, i, payload in whole:
            harm = rng.choice(["", "", "", "flip", "lost", "cut", "junk", "twice"])
            if harm == "junk":  # lies before a record that stays whole
                parts.append(rng.choice([bytes(rng.randrange(256) for _ in range(rng.randrange(1, 900))), b"\x1f\x8b\x08", b"WARC/1.1\r\n", b"\r\n" * 3, b"WARC/1.0\r\nContent-Length: 99999999\r\nWARC-Type: x\r\nWARC-Record-ID: y\r\n\r\n"]))
            if harm in ("", "junk", "twice"):
                parts += [raw] * (1 + (harm == "twice"))
                want += [(i, payload)] * (1 + (harm == "twice"))
                continue
            # What a digest or a checksum covers: all of a member but its time and flags, the block of a plain record.
            first = 10 if zipped else raw.index(b"\r\n\r\n") + 4
            a = rng.randrange(first, len(raw) - 8)
            flipped = raw[:a] + bytes([raw[a] ^ 1 << rng.randrange(8)]) + raw[a + 1 :]
            parts.append({"flip": flipped, "lost": raw[:a] + raw[a + 7 :], "cut": raw[:a]}[harm])
        rows = scan(b"".join(parts))
        got = [(r[2]["warc-record-id"], r[3]) for r in rows if r[5] is None]
        # Beyond those left whole, a record may come that is whole itself while its member is damaged behind it.
        left = iter(got)
        assert all(any(x == y for y in left) for x in want) and {*got} <= {(i, p) for _, i, p in whole} and (zipped or got == want)
        assert len(got) < len(want) + 4
        assert all(r[2] is None and r[5] for r in rows if r[5] is not None)


def test_salvage_kinds_of_members():
    """Several records in a member, an archive zipped as a whole, other digests, foreign records, nothing at all."""
    whole = made(6, False, 9)
    plain = b"".join(x for x, *_ in whole)
    for raw in (warc.member(plain), plain + warc.member(plain[: len(whole[0][0])]), b"".join(warc.member(a + b) for (a, *_), (b, *_) in zip(whole[::2], whole[1::2]))):
        rows = list(warc.salvaged(warc.Window(lambda n, at: raw[at : at + n], len(raw))))
        assert [r[2]["warc-record-id"] for r in rows][:6] == [i for _, i, _ in whole] and all(r[5] is None for r in rows)
    # A member of several records that breaks off: those before stay, then the next member.
    first, second = warc.member(plain), warc.member(whole[0][0])
    raw = first[: len(first) * 2 // 3] + second
    rows = list(warc.salvaged(warc.Window(lambda n, at: raw[at : at + n], len(raw))))
    assert rows[0][2]["warc-record-id"] == whole[0][1] and rows[-1][0] == len(raw) - len(second) and [r for r in rows if r[5]]
    block = b"plain text"
    sha1 = __import__("base64").b32encode(hashlib.sha1(block).digest()).decode()
    other = lambda digest: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <u>\r\nX-Long: a\r\n b\r\nWARC-Block-Digest: {digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    for digest, fault in ((f"sha1:{sha1}", None), (f"md5:{hashlib.md5(block).hexdigest()}", None), ("blake3:abc", None), ("sha1:" + "A" * 32, "block digest"), ("sha256:00", "block digest")):
        (row,) = scan(other(digest))
        assert row[5] == fault and (fault or (row[3] == block and row[2]["x-long"] == "a b"))
    assert scan(b"") == [] and [r[5] for r in scan(b"x")] == ["no version line"] and [r[5] for r in scan(b"\x1f\x8b\x08")] == ["member cut off"]
    assert [r[5] for r in scan(zlib.compress(plain))] == ["no version line"]


HTML = [(1, "u1", "x" * 200), (2, "u2", "y" * 99), (3, "u3", "y" * 99), (4, None, "x" * 200), (5, "http://h/\r\nX: 1", "x" * 200), (6, "u6", None), (7, "u7", ""), (8, "u8", "é" * 50), (9, "u9", "é" * 50), (None, "n", "x" * 200), (None, "n", "z" * 300), (None, "n", "z" * 300), (1, "u1", "x" * 200), (11, "u11", "WARC/1.1\r\n\x1f" + "日" * 9000), (0, "late", "x" * 150), (12, "http://long/" + "é" * 300_000, "long url"), (13, " ", "\r\n\r\n")]


def test_archives(spark, tmp_path):
    """Every row comes back; equal payloads of 100 bytes are written once, whatever else the table holds."""
    pages = spark.createDataFrame([(i, u, h, "keep", "mine") for i, u, h in HTML] * 1 + [(100 + i, "hot", "h" * 500, "keep", "mine") for i in range(300)], "page_id long, url string, html string, digest string, first string").repartition(4)
    for zipped in (True, False):
        folder = f"file://{tmp_path}/archive {zipped}"
        files = warc.write(pages, folder, zipped=zipped, roll=3000).collect()
        assert sorted(p.name for p in (tmp_path / f"archive {zipped}").iterdir() if p.name[0] != ".") == sorted(f.file for f in files) and sum(f.records for f in files) == 317 and len(files) > 8
        for streamed in (True, False):
            scanned = warc.salvage(spark, folder, streamed)
            assert warc.quarantined(scanned).count() == 0
            texts = sorted((r.headers.get("page-id"), bytes(r.payload).decode()) for r in warc.records(scanned).where("type = 'response'").collect() if r.headers.get("page-id"))
            assert ("11", HTML[13][2]) in texts and len([t for _, t in texts if t == "h" * 500]) == 1
            got = warc.resolved(scanned).collect()
            size = lambda h: len((h or "").encode())
            want = [(i, "revisit" if i in (4, 5, 9) or i is None and h[0] == "x" else "response", size(h), sha(h or ""), {4: 1, 5: 1, 9: 8}.get(i, 1 if i is None and h[0] == "x" else None)) for i, _, h in HTML]
            want += [(100 + i, "revisit" if i else "response", 500, sha("h" * 500), 100 if i else None) for i in range(300)]
            assert sorted(map(repr, ((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got))) == sorted(map(repr, want)) and all(r.found for r in got)
    none = f"file://{tmp_path}/none"
    assert warc.write(pages.limit(0), none).count() == 0 and warc.salvage(spark, none).count() == 0 == warc.resolved(warc.salvage(spark, none)).count()


def test_damaged_archives(spark, tmp_path):
    """Lost answers: revisits keep what their own head says. The gaps are logged."""
    pages = spark.createDataFrame([(i, f"u{i}", f"{i % 40} " * 100) for i in range(80)], "page_id long, url string, html string").coalesce(1)
    folder = tmp_path / "w"
    warc.write(pages.orderBy("page_id").coalesce(1), f"file://{folder}")
    (path,) = [p for p in folder.iterdir() if p.name[0] != "."]
    rows = {r.page_id: r for r in warc.records(warc.salvage(spark, str(folder))).select(F.col("headers")["page-id"].cast("int").alias("page_id"), "start", "end").collect()}
    raw = bytearray(path.read_bytes())
    for i in (3, 4, 70):
        raw[rows[i].start + 30] ^= 0xFF
    path.write_bytes(raw)
    scanned = warc.salvage(spark, str(folder))
    gaps = sorted((r.start, r.end) for r in warc.quarantined(scanned).collect())
    merged = []
    for a, b in sorted((rows[i].start, rows[i].end) for i in (3, 4, 70)):
        merged = [*merged[:-1], (merged[-1][0], b)] if merged and merged[-1][1] == a else [*merged, (a, b)]
    assert gaps == merged
    got = {r.page_id: r for r in warc.resolved(scanned).collect()}
    assert set(got) == set(range(80)) - {3, 4, 70}
    assert not got[43].found and got[43].refers_to is None and (got[43].payload_bytes, got[43].payload_digest) == (200, sha("3 " * 100))
    assert got[45].found and got[45].refers_to == 5
    warc.log_gaps(scanned, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == len(merged)


def test_queries_where_pages_repeat(spark, tmp_path):
    """The query over a table with copies, held against its SQL."""
    import duckdb

    spark.createDataFrame([(i, f"u{i}", ("copy " * 50 if i % 3 == 0 else f"{i} " * (i % 70)) if i % 11 else None) for i in range(400)], "page_id long, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.op13_warc(spark, str(tmp_path))
    names = sorted(got.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == sorted(repr(r) for r in con.sql(queries.OP13_SQL).project(", ".join(names)).fetchall())
    assert got.where("record_type = 'revisit'").count() > 100


@pytest.mark.parametrize("bits", [1 << 15, 1 << 25])
def test_sieves(spark, monkeypatch, bits):
    """Suspects hold all rows that are asked for; what is left out is left out exactly, with a full sieve too."""
    from webloom.llm import common

    monkeypatch.setattr(common, "SIEVE", bits)
    df = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(5, "again"), (None, "null")], "id long, _gone string").withColumn("a.b", F.lit("dot")).withColumn("_page", F.lit("mine"))
    for gone, null in (([5, 7, 2999, 10**9], False), (range(0, 6000, 2), True), ([], False)):
        keys = spark.createDataFrame([(i,) for i in gone] + [(None,)] * null, "k long")
        kept = common.without(df, F.col("id"), keys)
        assert kept.columns == df.columns and sorted(r._gone for r in kept.collect()) == sorted(r._gone for r in df.collect() if r.id not in set(gone) and not (null and r.id is None))
        some = [r.id for r in common.suspects(df, F.col("id"), keys).collect()]
        assert {*gone} & set(range(3000)) <= set(some) and (bits == 1 << 15 or len(some) <= 1.1 * len(gone) + 3)
    assert common.without(df.limit(0), F.col("id"), keys).count() == 0
