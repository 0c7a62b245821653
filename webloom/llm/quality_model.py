"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network with calibrated output.

Every word has a fixed sparse ternary index vector, drawn by its hash; a word's vector is the sum of the index
vectors of its neighbours over the sample. A document's words are pooled by mean, spread, mean absolute step from
each word to the next, and total on a logarithmic scale: topic, variety, repetition and length, all of them from the
word vectors alone. A network of one hidden layer is trained with numpy, and its output is divided by a temperature
that minimises the loss on rows kept from training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import words
from webloom.llm.common import quoted
from webloom.llm.labelled import TRAIN_ROWS, TRAIN_TASKS, Adam, sigmoid, training_rows

#: Word vectors (by hash), dimensions, ones of an index vector, neighbours on each side; figures of a pooled document.
WORDS, DIMS, ONES, WINDOW = 1 << 14, 32, 4, 2
POOLED = 4 * DIMS
#: Words that are pooled at once.
PIECE = 1 << 16
HIDDEN, EPOCHS, RATE = 32, 60, 0.01


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float


def index_vectors() -> np.ndarray:
    """The ternary index vectors, the same everywhere."""
    rng = np.random.Generator(np.random.PCG64(4242))
    out = np.zeros((WORDS, DIMS), np.float32)
    at = np.argsort(rng.random((WORDS, DIMS)), axis=1)[:, :ONES]
    np.put_along_axis(out, at, np.where(rng.random((WORDS, ONES)) < 0.5, -1, 1).astype(np.float32), 1)
    return out


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bounds of the texts) of all words; case counts."""
    out, counts = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for raw, at, first in words.pieces(texts, words.WHITE):
        data = np.frombuffer(raw, np.uint8)
        a, b = words.spans(data, words.WHITE)
        out.append((words.hash_spans(data, a, b, lower=False) >> np.uint64(50)).astype(np.int64))
        of = np.searchsorted(np.asarray(first), a, "right") - 1
        np.add.at(counts, np.asarray(at), np.bincount(of, minlength=len(at)))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of neighbours' index vectors for each row, over this task's texts."""
    index, out = index_vectors(), np.zeros((WORDS, DIMS), np.float32)
    for batch in batches:
        for text in words.as_bytes(batch.column(1)):
            rows, _ = word_rows([text])
            for d in range(1, WINDOW + 1):
                np.add.at(out, rows[d:], index[rows[:-d]])
                np.add.at(out, rows[:-d], index[rows[d:]])
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table of the tasks' tables. What is added are whole numbers, so that their order changes nothing."""
    out = np.zeros((WORDS, DIMS), np.float32)
    for batch in batches:
        for sums in batch.column(0):
            out += np.frombuffer(sums.as_buffer(), np.float32).reshape(WORDS, DIMS)
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row per text of its words' vectors: mean, spread, mean absolute step, signed logarithm of the sum; zeros for no word."""
    rows, bounds = word_rows(texts)
    out = np.zeros((len(texts), POOLED), np.float32)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        n = b - a
        if not n:
            continue
        total, squares, steps = np.zeros((3, DIMS))
        for lo in range(a, b, PIECE):
            v = vectors[rows[lo : min(b, lo + PIECE + 1)]]  # one word more, for the step to it
            own = v[:PIECE]
            total += own.sum(0, dtype=float)
            squares += (own * own).sum(0, dtype=float)
            steps += np.abs(v[1:] - v[:-1]).sum(0, dtype=float)
        mean = total / n
        out[i] = np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)), steps / max(n - 1, 1), np.sign(total) * np.log1p(np.abs(total))])
    return out


def _pool(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [row.tolist() for texts in words.in_parts(batch.column(1), 64) for row in pooled(texts, shared.value)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), batch.column(2).cast(pa.int32())], ["x", "label"])

    return run


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ layers[0] + layers[1])
    return h, h @ layers[2] + layers[3]


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """The model of up to ``rows`` labelled documents that are not held out; word vectors come from the same rows.

    The driver gets one table of fixed size, and a row of fixed size for each sampled document. With rows of one
    class only, the model tends to that class; with none, it says 0.5. Ids with both labels are left out. The order
    of rows changes nothing.
    """
    context = df.sparkSession.sparkContext
    train = training_rows(df, labels, label, doc_id, text, rows).repartition(TRAIN_TASKS).persist()
    try:
        sums = train.mapInArrow(_contexts, "sums binary").repartition(1).mapInArrow(_summed, "sums binary").first()["sums"]
        vectors = np.frombuffer(sums, np.float32).reshape(WORDS, DIMS)
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        # A word that the sample lacks keeps its own index vector.
        vectors = np.where(norm > 0, vectors / np.maximum(norm, 1e-9), index_vectors() / 2).astype(np.float32)
        found = train.mapInArrow(_pool(context.broadcast(vectors)), "x array<float>, label int").toArrow()
    finally:
        train.unpersist()
    x = found["x"].combine_chunks().values.to_numpy().reshape(-1, POOLED).astype(np.float64) if len(found) else np.zeros((0, POOLED))
    y = found["label"].to_numpy().astype(np.float64)
    order = np.lexsort(np.column_stack([x, y]).T)  # rows come in any order; training must not depend on it
    return Model(vectors, *trained(x[order], y[order]))


def trained(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """(mean, spread, layers, temperature): the network of rows ``x`` with labels ``y``, every fifth kept for the temperature."""
    rng = np.random.Generator(np.random.PCG64(5))
    layers = [rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    if not len(y):
        layers[2][:] = 0
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), layers, 1.0
    mean, spread = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / spread
    mixed = rng.permutation(len(y))
    held, own = mixed[: len(y) // 5], mixed[len(y) // 5 :]
    adam = Adam(layers, RATE)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // 256)):
            h, z = _forward(layers, x[batch])
            g = (sigmoid(z) - y[batch]) / len(batch)
            back = np.outer(g, layers[2]) * (1 - h * h)
            adam.step([x[batch].T @ back + 1e-4 * layers[0], back.sum(0), h.T @ g + 1e-4 * layers[2], np.array([g.sum()])])
    z = _forward(layers, x[held])[1] if len(held) else np.zeros(0)
    loss = lambda t: -np.mean(y[held] * np.log(sigmoid(z / t) + 1e-12) + (1 - y[held]) * np.log(1 - sigmoid(z / t) + 1e-12)) if len(z) else 0.0
    return mean, spread, layers, float(min(np.geomspace(0.25, 8, 61), key=loss))


def score(df: DataFrame, model: Model, text: str = "text") -> Column:
    """A column: the calibrated probability of label 1 for the whole text. Null and empty texts pool to zeros."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in batches:
            out = [np.zeros(0)]
            for texts in words.in_parts(column, 64):
                x = (pooled(texts, m.vectors) - m.mean) / m.spread
                # Sums row by row: a matrix product's last bits hang on how many rows come at once.
                h = np.tanh((x[:, :, None] * m.layers[0]).sum(1) + m.layers[1])
                out.append(sigmoid(((h * m.layers[2]).sum(1) + m.layers[3]) / m.temperature))
            yield pa.array(np.concatenate(out))

    return scored(F.col(quoted(text)))
