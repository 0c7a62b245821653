"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of bytes inside words (a word with a space on either side), A-Z lower-cased, present or
absent in a document. Each is scaled by the log ratio of its smoothed shares in toxic and other documents, and a
logistic regression is fitted on the scaled features. Whole texts are scored; the model is a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import words
from webloom.llm.common import Scratch, quoted
from webloom.llm.labelled import TRAIN_ROWS, TRAIN_TASKS, Adam, sigmoid, training_rows

NGRAMS, BITS = (4, 6), 22
#: Parts of the table of counts, in which tasks send it on and add it up.
SLICES = 64
SLICE = (1 << BITS) // SLICES
#: Features of the model at most, and documents that must have one.
FEATURES, MIN_DOCS = 3000, 8
_TABLE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]
_TABLE[words.SIGNS] = _TABLE[32]
_SALT = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Model:
    """``ids`` are the buckets of the features, ``weights`` what their presence adds, ``bias`` what all get."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float


def ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, number of the text of each) of all n-grams, piece by piece."""
    for raw, at, first in words.pieces(texts, words.SIGNS):
        data = np.frombuffer(b" " + raw + b" ", np.uint8)
        inner = np.concatenate([[0], np.cumsum(words.SIGNS[data], dtype=np.int32)])
        p, q = words.powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * p[:-1], out=total[1:])
        of = np.asarray(at)[np.searchsorted(np.asarray(first) + 1, np.arange(len(data)) + 1, "right") - 1]
        for n in NGRAMS:
            m = len(data) - n + 1
            if m <= 0:
                continue
            h = ((total[n:] - total[:m]) * q[:m] + np.uint64(n)) * _SALT >> np.uint64(64 - BITS)
            word = inner[n - 1 : n - 1 + m] == inner[1 : m + 1]  # no separator between the first and the last byte
            yield h[word].astype(np.int64), of[:m][word]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = np.zeros(2, np.int64)
    seen = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        labels = batch.column(2).to_numpy(zero_copy_only=False)
        for a, texts in zip(range(0, len(labels), 64), words.in_parts(batch.column(1), 64), strict=True):
            parts = [np.unique(of * (1 << BITS) + h) for h, of in ngrams(texts)]
            keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            of, h = keys >> BITS, keys & ((1 << BITS) - 1)
            some = labels[a : a + 64]
            for y in (0, 1):
                np.add.at(seen[y], h[some[of] == y], 1)
                docs[y] += int((some == y).sum())
    # Every count goes on, those of one document too: only their sums over all tasks say which n-grams are rare.
    for k in range(SLICES):
        part = seen[:, k * SLICE : (k + 1) * SLICE]
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([int(docs[y]) * (not k)], pa.int64()) for y in (1, 0)), *(pa.array([part[y].tobytes()], pa.binary()) for y in (1, 0))], ["slice", "n1", "n0", "pos", "neg"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, pos, neg) of the buckets that MIN_DOCS documents have, from all tasks' counts of a slice; documents at -1."""
    sums: dict[int, np.ndarray] = {}
    docs = np.zeros(2, np.int64)
    for batch in batches:
        for k, n1, n0, pos, neg in zip(*(c if i > 2 else c.to_pylist() for i, c in enumerate(batch.columns)), strict=True):
            docs += (n1, n0)
            sums.setdefault(k, np.zeros((2, SLICE), np.int32))
            for y, raw in enumerate((pos, neg)):
                sums[k][y] += np.frombuffer(raw.as_buffer(), np.int32)
    for k, both in sums.items():
        at = np.flatnonzero(both.sum(0) >= MIN_DOCS)
        yield pa.RecordBatch.from_arrays([pa.array(at + k * SLICE), *(pa.array(both[y][at].astype(np.int64)) for y in (0, 1))], ["h", "pos", "neg"])
    if docs.any():
        yield pa.RecordBatch.from_arrays([pa.array([-1]), *(pa.array([int(n)]) for n in docs)], ["h", "pos", "neg"])


def _presence(chosen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[chosen.value] = np.arange(len(chosen.value))
        for batch in batches:
            out = [x.tolist() for texts in words.in_parts(batch.column(1), 64) for x in present(texts, slot)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column(2).cast(pa.int32())], ["x", "label"])

    return run


def present(texts: list[bytes], slot: np.ndarray) -> list[np.ndarray]:
    """Per text the features that it has."""
    keys = []
    for h, of in ngrams(texts):
        s = slot[h]
        hit = s >= 0
        keys.append(np.unique(of[hit].astype(np.int64) << 32 | s[hit]))
    k = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    bounds = np.searchsorted(k >> 32, np.arange(len(texts) + 1))
    return [k[a:b] & 0xFFFFFFFF for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def fit(df: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, features: int = FEATURES, penalty: float = 1e-4) -> Model:
    """The model of up to ``rows`` labelled documents that are not held out.

    Counts are made and added up in the tasks, as tables of fixed size; the driver gets the ``features`` buckets that
    tell the classes apart best, chosen in the tasks too, and which of them each sampled document has (``rows`` lists
    of ``features`` numbers at most). With no document of one class the model is constant. Ids with both labels are
    left out, and an id that is repeated counts once. Neither the order of rows nor how they are dealt changes a bit.
    """
    own = Scratch(df.sparkSession, "toxicity")
    train = training_rows(df, labels, label, doc_id, text, rows).repartition(TRAIN_TASKS).persist()
    try:
        counts = train.mapInArrow(_counts, "slice int, n1 long, n0 long, pos binary, neg binary").repartition("slice").mapInArrow(_summed, "h long, pos long, neg long").persist()
        docs = counts.where("h = -1").first()
        n1, n0 = (docs["pos"], docs["neg"]) if docs else (0, 0)
        none = np.zeros(0, np.int64)
        if not n1 or not n0:
            return Model(none, np.zeros(0), 0.0 if not n1 + n0 else (6.0 if n1 else -6.0))
        # Chi-square of presence against class.
        p, q = F.col("pos").cast("double"), F.col("neg").cast("double")
        gap = p * (n0 - q) - q * (n1 - p)
        score = gap * gap / ((p + q) * (n1 + n0 - p - q + 1))
        best = counts.where("h >= 0").select("h", "pos", "neg", score.alias("score")).orderBy(F.desc("score"), "h").limit(features)
        # Written, not collected: a collected limit brings that many rows of each partition to the driver.
        best = own.save(best, "best").orderBy("h").toPandas()
        own.drop("best")
        ids = best["h"].to_numpy(np.int64)
        ratio = np.log((best["pos"].to_numpy() + 1.0) / (n1 + 1)) - np.log((best["neg"].to_numpy() + 1.0) / (n0 + 1))
        found = train.mapInArrow(_presence(df.sparkSession.sparkContext.broadcast(ids)), "x array<int>, label int").toArrow()
        counts.unpersist()
    finally:
        train.unpersist()
    # Rows come in any order; sums must not depend on it.
    found = found.take(pa.array(sorted(range(len(found)), key=list(zip(found["label"].to_pylist(), found["x"].to_pylist(), strict=True)).__getitem__), pa.int64()))
    x = found["x"].combine_chunks()
    at, row = x.values.to_numpy(), np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))
    y = found["label"].to_numpy().astype(float)
    w, b = np.ones(len(ids)) * 0.1, np.array([np.log(n1 / n0)])
    adam = Adam([w, b], 0.05)
    for _ in range(300):
        z = np.bincount(row, (w * ratio)[at], len(y)) + b
        g = (sigmoid(z) - y) / len(y)
        adam.step([np.bincount(at, g[row], len(ids)) * ratio + penalty * w, np.array([g.sum()])])
    return Model(ids, w * ratio, float(b[0]))


def score(df: DataFrame, model: Model, text: str = "text") -> Column:
    """A column: the probability that the whole text is toxic. Null and empty texts get that of no features."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        slot = np.full(1 << BITS, -1, np.int32)
        slot[m.ids] = np.arange(len(m.ids))
        for column in batches:
            z = []
            for texts in words.in_parts(column, 64):
                z += [m.weights[x].sum() for x in present(texts, slot)]
            yield pa.array(sigmoid(np.array(z, float) + m.bias))

    return scored(F.col(quoted(text)))


def without_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` without the documents that score ``threshold`` or more."""
    return df.where(score(df, model, text) < threshold)
