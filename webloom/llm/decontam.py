"""Benchmark decontamination by greedy string tiling.

Seeds are the runs of ``seed`` words of the benchmark's items. Documents are read once; of each stay the stretches
that seeds may cover, told by a bitmap of fixed size, and these few are joined with the items' seeds. For each
document and item that meet, running Karp-Rabin marks the longest common runs one after another, without overlap:
windows of a falling search length are compared by rolling hash, what matches is extended, the longest is marked
first, and a match that earlier marks have cut comes back as what is left of it. The share of an item's words under
tiles is its coverage; tiles may stand in any order, so reordered passages count as whole ones do.

The benchmark may be of any size: it is a table that is joined, and the driver gets no more than the bitmap.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm import words
from webloom.llm.common import Scratch, quoted, without

SEED, COVERAGE = 5, 0.5
#: Bits of the bitmap of seeds.
SIEVE = 1 << 25
_HITS = "doc_id long, item_id long, item_words long, matched_words long, n_tiles long, longest long, coverage double"
_U = np.uint64


def _windows(h: np.ndarray, s: int) -> np.ndarray:
    """The rolling hash of each run of s word hashes."""
    p, q = words.powers(len(h) + 1)
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * p[:-1], out=total[1:])
    return (total[s:] - total[:-s]) * q[: len(h) - s + 1]


def _free(taken: np.ndarray, s: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Where a run of s words without marks begins, and one that stays inside a stretch if their starts are given."""
    n = np.concatenate([[0], np.cumsum(taken)])
    out = n[s:] == n[:-s]
    if starts is not None:
        m = np.concatenate([[0], np.cumsum(starts)])
        out &= m[s:] == m[1 : len(starts) - s + 2]
    return out


def _matches(doc: np.ndarray, item: np.ndarray, s: int, doc_free: np.ndarray, item_free: np.ndarray, starts: np.ndarray | None) -> list[tuple[int, int, int]]:
    """(-length, start in item, start in doc) of each maximal common run of s words or more, all of them free, by hash."""
    i, j = np.flatnonzero(doc_free), np.flatnonzero(item_free)
    a, b = _windows(doc, s)[i], _windows(item, s)[j]
    order = np.argsort(b, kind="stable")
    j, b = j[order], b[order]
    lo, hi = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    many = hi - lo
    if not many.any():
        return []
    at = np.repeat(i, many)
    to = j[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    # Neighbours on a diagonal are one run.
    order = np.lexsort((at, at - to))
    at, to = at[order], to[order]
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(to) != 1)])
    if starts is not None:
        new |= starts[at] == 1
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(at)]])) + s - 1
    return list(zip((-size).tolist(), to[first].tolist(), at[first].tolist(), strict=True))


def tiles(doc: np.ndarray, item: np.ndarray, seed: int, lengths: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length): greedy tiles of at least ``seed`` words, longest first.

    ``doc`` may be stretches of a text put together, of ``lengths`` words each; no tile spans two. Of equally long
    matches the one that stands first in the item, then in the document, is marked.
    """
    starts = None
    if lengths is not None:
        starts = np.zeros(len(doc), np.int64)
        starts[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = 1
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out: list[tuple[int, int, int]] = []
    s = min(len(doc), len(item))
    while s >= seed:
        item_free = _free(in_item, s)
        if item_free.any():
            queue = _matches(doc, item, s, _free(in_doc, s, starts), item_free, starts)
            heapify(queue)
            while queue:
                n, j, i = heappop(queue)
                n = -n
                taken = in_doc[i : i + n] | in_item[j : j + n]
                if not taken.any():
                    if np.array_equal(doc[i : i + n], item[j : j + n]):
                        out.append((i, j, n))
                        in_doc[i : i + n] = in_item[j : j + n] = True
                        if in_item.all():
                            return out
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if b - a >= s:
                        heappush(queue, (a - b, j + a, i + a))
        if s == seed:
            break
        s = max(seed, s // 2)
    return out


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a = 0
        for texts in words.in_parts(batch.column(2)):
            h, bounds = words.hashed_words(texts, words.SIGNS)
            n = np.diff(bounds)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(n)), batch.column(1).slice(a, len(n)), pa.array(n, pa.int64()), lists], ["item", "item_id", "n", "words"])
            a += len(n)


def _seeds(seed: int, coverage: float):
    """(item, h, need) of each seed of each item; ``need`` of an item's seeds hold one at least of a covering document.

    A tile of n words holds n - seed + 1 >= n / seed seeds, so a document that covers the share of an item's words
    holds the share / seed of them as seeds: all but that many, whichever, must meet it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = w.values.to_numpy().view(_U)
                k = min(seed, len(w))
                g = words.grams(w, k)
                need = len(g) - max(1, int(np.ceil(coverage * len(w) / k - 1e-9))) + 1
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(g), pa.int64()), pa.array(g.view(np.int64)), pa.array([max(1, need)] * len(g), pa.int64())], ["item", "h", "need"])

    return run


def _stretches(shared, lengths: list[int]):
    """Of each document that may hold a seed: the words of the stretches that seeds cover, their lengths, the seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            a = 0
            rows: list[tuple] = []
            for texts in words.in_parts(batch.column(2)):
                h, bounds = words.hashed_words(texts, words.SIGNS)
                cover, of, hit = np.zeros(len(h) + 1, np.int32), [], []
                for k in lengths:
                    g = words.grams(h, k)
                    p = g & _U(SIEVE - 1)
                    at = np.flatnonzero(sieve[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8) & 1)
                    d = np.searchsorted(bounds, at, "right") - 1
                    inside = at + k <= bounds[d + 1]
                    at, d = at[inside], d[inside]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + k, -1)
                    of.append(d)
                    hit.append(g[at])
                covered, of, hit = np.cumsum(cover) > 0, np.concatenate(of), np.concatenate(hit)
                for d in np.unique(of).tolist():
                    x, y = int(bounds[d]), int(bounds[d + 1])
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered[x:y], [False]]).astype(np.int8)))
                    rows.append((a + d, h[x:y][covered[x:y]].view(np.int64), (edges[1::2] - edges[::2]).astype(np.int32), np.unique(hit[of == d]).view(np.int64)))
                a += len(texts)
            if rows:
                which, *lists = zip(*rows, strict=True)
                arrays = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)], dtype=np.int32)), pa.array(np.concatenate(x))) for x in lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(which)) for j in (0, 1)), *arrays], ["doc_id", "key", "words", "lengths", "seeds"])

    return run


def _tile(seed: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for r in range(batch.num_rows):
                doc, lengths, item = (batch.column(c)[r].values.to_numpy() for c in ("doc_words", "lengths", "words"))
                found = tiles(doc.view(_U), item.view(_U), min(seed, len(item)), lengths)
                matched = sum(n for *_, n in found)
                if found and matched >= coverage * len(item):
                    rows.append((batch.column("doc_id")[r].as_py(), batch.column("item_id")[r].as_py(), len(item), matched, len(found), max(n for *_, n in found), matched / len(item)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if j == 6 else pa.int64()) for j, x in enumerate(zip(*rows, strict=True))], ["doc_id", "item_id", "item_words", "matched_words", "n_tiles", "longest", "coverage"])

    return run


def sieve_of(seeds: DataFrame) -> bytes:
    """The bitmap of the seeds' low bits: SIEVE bits, whatever their number. One in use too often lets more through."""
    place = F.pmod(F.col("h"), F.lit(SIEVE)) + 1
    parts = seeds.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    size = 4096
    out = bytearray(SIEVE // 8)
    for row in parts:
        out[(row["part"] - 1) * size : row["part"] * size] = row["bits"]
    return bytes(out)


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, matched_words, n_tiles, longest, coverage) of each item that a document covers.

    Words are runs of letters and digits (all beyond ASCII included), A-Z lower-cased. An item of fewer words than
    ``seed`` must stand in the document whole; one without words, or null, matches nothing, and nothing matches in
    null or empty texts. Rows that repeat an id are judged each by its text, rows that repeat both count once; so do
    the benchmark's. An id may be null; one that is no whole number is refused with an error. The result reads tables
    of the shared scratch folder.
    """
    own = Scratch(df.sparkSession, "decontam")
    named = benchmark.select(F.col(quoted(item_id)).cast("long").alias("item_id"), F.coalesce(F.col(quoted(item_text)), F.lit("")).alias("text")).distinct()
    items = own.save(named.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(_items, "item long, item_id long, n long, words array<long>").where("n > 0"), "items")
    seeds = own.save(items.select("item", "words").mapInArrow(_seeds(seed, coverage), "item long, h long, need long"), "seeds")
    lengths = sorted(r[0] for r in items.select(F.least(F.col("n"), F.lit(seed))).distinct().collect())
    if not lengths:
        return df.sparkSession.createDataFrame([], _HITS)
    shared = df.sparkSession.sparkContext.broadcast(sieve_of(seeds))
    docs = df.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    found = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(_stretches(shared, lengths), "doc_id long, key long, words array<long>, lengths array<int>, seeds array<long>")
    docs = own.save(found, "stretches")
    # Of each item the seeds that are rarest in the documents, then in the benchmark: a phrase that many documents or
    # items share brings none of them where the item has another.
    common = seeds.groupBy("h").agg(F.count_distinct("item").alias("n_items"))
    seen = docs.select(F.explode("seeds").alias("h")).groupBy("h").agg(F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("n_docs", F.lit(0)), "n_items", "h"))
    probes = seeds.join(common, "h").join(seen, "h", "left").withColumn("rank", rank).where("rank <= need")
    # Written first: joins of plain shuffles, whose hot partitions are split by their size, whatever it is.
    probes = own.save(probes.select("item", "h").distinct(), "probes")
    met = own.save(docs.select("doc_id", "key", F.explode("seeds").alias("h")).join(probes, "h").select("doc_id", "key", "item").distinct(), "met")
    held = docs.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("words").alias("doc_words"), "lengths").dropDuplicates(["d", "k"])
    pairs = met.join(held, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).join(items, "item")
    return pairs.select("doc_id", "item_id", "doc_words", "lengths", "words").mapInArrow(_tile(seed, coverage), _HITS)


def decontaminate(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``df`` without the documents that cover a benchmark item. Rows of null id stay only if no null id is hit."""
    hits = Scratch(df.sparkSession, "contaminated").save(contaminated(df, benchmark, doc_id, text, **how).select("doc_id").distinct(), "ids")
    return without(df, F.col(quoted(doc_id)).cast("long"), hits)
