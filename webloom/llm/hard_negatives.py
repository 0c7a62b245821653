"""Hard negatives by one-dimensional distance keys.

Vectors are scaled to whole numbers and augmented by one component, so that all have the norm M of the longest; the
distance of a query (augmented by 0) then falls as its inner product rises: d^2 = |q|^2 + M^2 - 2 score. Each vector
gets the nearest of some pivots and its distance to it as key. The index is stored sorted by (pivot, key), packed
into segments of neighbouring keys. What lies within R of a query has, at each pivot, a key within R of the query's
own distance to that pivot; so a search scans the segments of these key intervals, and widens them until R reaches
the distance of the last of the best found: nothing outside can then be better.

Queries go in blocks of neighbours, and a block meets a segment once, as one matrix product; each task keeps the
best of what it sees. Neither the rows nor the queries are collected or broadcast, and no pair is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import Scratch, quoted

#: Pivots, rows that they are chosen from, rows of a segment, queries of a block; queries that are multiplied at once, blocks
#: that a task holds results of.
PIVOTS, SAMPLE, SEGMENT, BLOCK, AT_ONCE, HELD = 32, 2048, 1024, 1024, 256, 4
#: Squared norms below this are exact in floating point, products and their ranks within a segment included.
EXACT = 2.0**42
#: The first radius, as a share of M.
START = 0.125
_LEAST, _MOST = -(2**63), 2**63 - 1
_SEGMENT = "block long, pivot int, lo double, hi double, n int, ids binary, labels binary, vectors binary"


def _matrix(column, dims: int) -> np.ndarray:
    """Whole-number vectors as rows of ``dims`` components; shorter ones are filled with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pivots(x: np.ndarray, most: float) -> np.ndarray:
    """Of sampled rows some that lie far from each other: each the farthest from those before."""
    far = np.sqrt(np.maximum(most - (x**2).sum(1), 0))
    between = lambda i: ((x - x[i]) ** 2).sum(1) + (far - far[i]) ** 2
    chosen = [0]
    near = between(0)
    while len(chosen) < PIVOTS and near.max(initial=0) > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, between(chosen[-1]))
    return x[chosen]


def _keyed(pivots: np.ndarray, most: float, dims: int):
    """Adds the nearest pivot, the distance to it, and the distances to all pivots as a query has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.sqrt(np.maximum(most - (pivots**2).sum(1), 0))
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                b = batch.slice(a, 4096)
                x = _matrix(b.column("v"), dims).astype(float)
                own = (x**2).sum(1)
                cross = x @ pivots.T
                up = np.sqrt(np.maximum(most - own, 0))
                between = np.sqrt(np.maximum(own[:, None] + (pivots**2).sum(1) - 2 * cross + (up[:, None] - far) ** 2, 0))
                asked = np.sqrt(np.maximum(own[:, None] + most - 2 * cross, 0))
                pivot = between.argmin(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * pivots.shape[0]), pa.array(asked.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot, pa.int32()), pa.array(between[np.arange(len(x)), pivot]), lists], [*b.schema.names, "pivot", "key", "asked"])

    return run


def _packed(size: int, dims: int, kind: str, together: bool):
    """Sorted rows as blocks of ``size`` at most, with rows of one pivot only if ``together``; rows of a block by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held, number = TaskContext.get().partitionId() << 32, [], 0

        def pack() -> pa.RecordBatch:
            nonlocal held, number
            ids, labels, pivot, key = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2, 3))
            v = np.concatenate([h[4] for h in held])
            at = np.argsort(ids, kind="stable")
            row = [first + number, int(pivot[0]), float(key.min()), float(key.max()), len(ids), ids[at].tobytes(), labels[at].tobytes(), v[at].astype(kind).tobytes()]
            held, number = [], number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "pivot", "lo", "hi", "n", "ids", "labels", "vectors"])

        count = 0
        for batch in batches:
            ids, labels, pivot, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "pivot", "key"))
            v = _matrix(batch.column("v"), dims)
            a = 0
            while a < len(ids):
                if held and (count == size or together and held[-1][2][-1] != pivot[a]):
                    yield pack()
                    count = 0
                b = min(len(ids), a + size - count)
                if together:
                    b = a + int(np.searchsorted(pivot[a:b], pivot[a], "right"))
                held.append((ids[a:b], labels[a:b], pivot[a:b], key[a:b], v[a:b]))
                count += b - a
                a = b
        if held:
            yield pack()

    return run


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products: exact in floating point, or else as whole numbers of any size, cut at 64 bits."""
    if q.dtype != object:
        return q @ x.T
    return np.clip(q @ x.T, _LEAST, _MOST) if q.shape[1] else np.zeros((len(q), len(x)), int).astype(object)


def _best(s: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the columns of the ``k`` greatest scores among ``ok``, lower columns first among equals: (row, column)."""
    n = s.shape[1]
    if s.dtype == object:
        rows = [(i, j) for i in range(len(s)) for j in sorted(np.flatnonzero(ok[i]), key=lambda j, i=i: (-s[i, j], j))[:k]]
        return np.array([r for r, _ in rows], int), np.array([c for _, c in rows], int)
    some = np.flatnonzero(ok.any(1))
    rank = np.where(ok[some], s[some] * n + np.arange(n - 1, -1, -1), -np.inf)
    at = np.argpartition(-rank, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), rank.shape)
    row, col = np.nonzero(np.take_along_axis(rank, at, 1) > -np.inf)
    return some[row], at[row, col]


def _scanned(dims: int, kind: str, exact: bool, slots: int, k: int, same: bool):
    """(anchor, slot, id, score): of each query and slot the best ``k`` that this task has seen inside the slot's limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def flush(block: int) -> pa.RecordBatch:
            ids, _, _, _, found = held.pop(block)
            row, slot, other, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
            return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(slot.astype(np.int32)), pa.array(other.astype(np.int64)), pa.array([int(x) for x in score] if score.dtype == object else score.astype(np.int64), pa.int64())], ["anchor", "slot", "id", "score"])

        def trimmed(found: list) -> list:
            """The best ``k`` of each query and slot."""
            row, slot, other, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((other, -score, slot, row)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], slot[i], -score[i], other[i])), int)
            row, slot, other, score = row[order], slot[order], other[order], score[order]
            group = row * slots + slot
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            place = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
            return [tuple(x[place < k] for x in (row, slot, other, score))]

        for batch in batches:
            for block, q_ids, q_labels, q_vectors, limits, ids, labels, vectors in zip(*(c if c.type == pa.binary() else c.to_pylist() for c in batch.columns), strict=True):
                if block not in held:
                    while len(held) >= HELD:
                        yield flush(next(iter(held)))
                    own = np.frombuffer(q_ids.as_buffer(), np.int64)
                    q = np.frombuffer(q_vectors.as_buffer(), kind).reshape(len(own), dims).astype(float if exact else object)
                    low, high = (np.full((len(own), slots), x, float if exact else object) for x in (1, 0))  # nothing lies between
                    place = {i: n for n, i in enumerate(own.tolist())}
                    for x in limits:
                        low[place[x["anchor"]], x["slot"]], high[place[x["anchor"]], x["slot"]] = x["low"], x["high"]
                    held[block] = (own, np.frombuffer(q_labels.as_buffer(), np.int64), q, (low, high), [])
                own, own_labels, q, (low, high), found = held[block]
                other, other_labels = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(labels.as_buffer(), np.int64)
                x = np.frombuffer(vectors.as_buffer(), kind).reshape(len(other), dims).astype(float if exact else object)
                for a in range(0, len(own), AT_ONCE):
                    s = _scores(q[a : a + AT_ONCE], x)
                    fits = (own_labels[a : a + AT_ONCE, None] == other_labels) == same
                    if same:
                        fits &= own[a : a + AT_ONCE, None] != other
                    for slot in range(slots):
                        ok = fits & (s >= low[a : a + AT_ONCE, slot, None]).astype(bool) & (s <= high[a : a + AT_ONCE, slot, None]).astype(bool)
                        row, col = _best(s, ok, k)
                        if len(row):
                            found.append((row + a, np.full(len(row), slot), other[col], s[row, col]))
                if len(found) > 4 * slots:
                    found[:] = trimmed(found)
        for block in list(held):
            if held[block][4]:
                held[block][4][:] = trimmed(held[block][4])
            yield flush(block)

    return run


def _search(own: Scratch, name: str, segments: DataFrame, blocks: DataFrame, anchors: DataFrame, slots: DataFrame, many: int, k: int, same: bool, most: float, dims: int, kind: str, exact: bool) -> DataFrame:
    """(anchor, slot, id, score) of the best ``k`` of each of ``slots`` (anchor, slot, low, high: limits of the score).

    Each round scans the segments that a block's key intervals reach and that it has not met yet, and then narrows
    the limits and sets the radii by what is found; it ends when no such segment is left.
    """
    reach = lambda score: F.sqrt(F.greatest(F.col("norm") + most - 2 * score, F.lit(0.0))) * (1 + 1e-9) + most**0.5 * 1e-9
    far = 2 * most**0.5 + 1
    directory = segments.select(F.col("block").alias("segment"), "pivot", F.col("lo").alias("from"), F.col("hi").alias("to"))
    whole = segments.select(F.col("block").alias("segment"), "ids", "labels", "vectors")
    asking = blocks.select("block", F.col("ids").alias("q_ids"), F.col("labels").alias("q_labels"), F.col("vectors").alias("q_vectors"))
    base = slots.join(anchors.select("anchor", "norm", "home"), "anchor")
    best = done = None
    made: list[str] = []
    held = ""
    radius, turn = START * most**0.5 if exact else far, 0
    while True:
        if best is None:
            state = base.withColumn("limit", F.col("low")).withColumn("radius", F.least(F.lit(radius), reach(F.col("low").cast("double"))))
        else:
            found = best.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("last"))
            state = base.join(found, ["anchor", "slot"], "left")
            # With k found nothing below the last is wanted; with fewer the interval widens, to where ``low`` lies at most.
            full = F.coalesce(F.col("n") == k, F.lit(False))
            state = state.withColumn("limit", F.when(full, F.col("last")).otherwise(F.col("low"))).withColumn("radius", F.when(full, reach(F.col("last").cast("double"))).otherwise(F.least(F.lit(radius), reach(F.col("low").cast("double")))))
        if not exact:
            state = state.withColumn("radius", F.lit(far))
        state = own.save(state.select("anchor", "slot", "home", "limit", "high", "radius"), f"{name}-state{turn}")
        made += [f"{name}-state{turn}", f"{name}-units{turn}"]
        wide = state.groupBy("anchor").agg(F.max("radius").alias("radius")).join(anchors.select("anchor", "home", "asked"), "anchor")
        wide = wide.select("home", "radius", F.posexplode("asked").alias("pivot", "at")).groupBy("home", "pivot").agg(F.min(F.col("at") - F.col("radius")).alias("a"), F.max(F.col("at") + F.col("radius")).alias("b"))
        units = wide.join(directory, "pivot").where("from <= b AND to >= a").select(F.col("home").alias("block"), "segment")
        if done is not None:
            units = units.join(done, ["block", "segment"], "left_anti")
        units = own.save(units, f"{name}-units{turn}")
        if units.isEmpty():
            if radius >= far or best is not None and base.join(best.groupBy("anchor", "slot").agg(F.count("*").alias("n")), ["anchor", "slot"], "left").where(F.coalesce("n", F.lit(0)) < k).isEmpty():
                break
            radius, turn = (far if turn > 8 else 4 * radius), turn + 1
            continue
        done = units if done is None else done.unionByName(units)
        limits = state.groupBy(F.col("home").alias("block")).agg(F.collect_list(F.struct("anchor", "slot", F.col("limit").alias("low"), "high")).alias("limits"))
        met = units.join(whole, "segment").join(asking, "block").join(limits, "block").select("block", "q_ids", "q_labels", "q_vectors", "limits", "ids", "labels", "vectors")
        got = met.mapInArrow(_scanned(dims, kind, exact, many, k, same), "anchor long, slot int, id long, score long")
        got = got if best is None else got.unionByName(best)
        rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
        last, best = best, own.save(got.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), f"{name}-best{turn}")
        if last is not None:
            own.drop(held)
        held = f"{name}-best{turn}"
        radius, turn = 4 * radius, turn + 1
    own.drop(*made)
    return best if best is not None else own.spark.createDataFrame([], "anchor long, slot int, id long, score long")


def hard_negatives(df: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    Components become floor(``scale`` * x) and a score is the inner product with the anchor, both cut at 64 bits;
    shorter vectors count as filled with 0. An anchor's positives are the best ``positives`` other rows of its label, and a positive's
    negatives the best ``negatives`` rows of other labels with ``low`` * p <= 100 * n <= ``high`` * p for the scores p and n; smaller ids
    come first among equals. Exact: all rows are searched, and pruning by distance only skips what cannot be in the
    result. Rows of null id, label or vector, or with a component that is null or not finite, take no part. Rows
    that repeat an id are one row, that of the least label and vector. An anchor without positives, or a positive
    without negatives, has no row; so has an empty table. Pivots are up to PIVOTS of the SAMPLE rows of the
    least hash of the id: they set the speed, never a result.
    """
    own = Scratch(df.sparkSession, "hard-negatives")
    whole = F.transform(F.col(quoted(vector)), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    bad = F.exists(F.col(quoted(vector)), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.select(F.col(quoted(vec_id)).cast("long").alias("id"), F.col(quoted(label)).cast("long").alias("label"), whole.alias("v"), bad.alias("bad"), anchor.alias("asks"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT bad")
    least = rows.groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("x")).select("id", "x.*")
    least = own.save(least.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), "rows")
    most, dims = least.agg(F.max("norm"), F.max(F.size("v"))).first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if most is None:
        return df.sparkSession.createDataFrame([], empty)
    exact, kind = most < EXACT, "<i4" if most < EXACT else "<i8"
    some = least.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).toArrow()
    points = _pivots(_matrix(some["v"].combine_chunks(), dims).astype(float), most)
    keyed = own.save(least.mapInArrow(_keyed(points, most, dims), "id long, label long, v array<long>, asks boolean, norm double, pivot int, key double, asked array<double>"), "keyed")
    own.drop("rows")
    dealt = lambda some: some.select("id", "label", "v", "pivot", "key").repartitionByRange("pivot", "key", "id").sortWithinPartitions("pivot", "key", "id")
    segments = own.save(dealt(keyed).mapInArrow(_packed(SEGMENT, dims, kind, True), _SEGMENT), "segments")
    asks = keyed.where("asks")
    blocks = own.save(dealt(asks).mapInArrow(_packed(BLOCK, dims, kind, False), _SEGMENT), "blocks")
    member = blocks.select(F.col("block").alias("home"), "ids").mapInArrow(_members, "home long, anchor long")
    anchors = own.save(asks.select(F.col("id").alias("anchor"), "norm", "asked").join(member, "anchor"), "anchors")
    own.drop("keyed")
    args = (segments, blocks, anchors)
    how = (most, dims, kind, exact)
    every = anchors.select("anchor", F.lit(0).alias("slot"), F.lit(_LEAST).cast("long").alias("low"), F.lit(_MOST).cast("long").alias("high"))
    found = _search(own, "positives", *args, every, 1, positives, True, *how)
    near = found.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id")) - 1)
    near = own.save(near.select("anchor", F.col("place").cast("int").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "near")
    # Limits in whole numbers: the least n with 100 n >= low p, and the greatest with 100 n <= high p.
    p = F.col("positive_score").cast("decimal(38,0)")
    limit = near.select("anchor", "slot", F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high")).where("low <= high")
    away = _search(own, "negatives", *args, limit, positives, negatives, False, *how)
    own.drop("segments", "blocks", "anchors")
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return away.join(near, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", rank.cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for home, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(ids.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), home)), pa.array(own)], ["home", "anchor"])
