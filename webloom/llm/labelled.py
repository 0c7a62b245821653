"""Labelled rows for the classifiers, and what their trainers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import quoted

#: Labelled rows that a classifier is fitted on at most: the bound of its sample.
TRAIN_ROWS = 12_000
#: Tasks that read the sample, each of which returns a table of fixed size.
TRAIN_TASKS = 8


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(df: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, label) of labelled documents that are not held out: ``rows`` of them at most, those of the least hash of the id.

    Rows whose label is null or neither 0 nor 1 are left out, and so are ids that have both labels. An id that the
    table repeats gives one row, that of the text with the least hash. Ids may be of any type; they are compared as
    text. The sample's ids are few, hence broadcast.
    """
    known = labels.select(F.col(quoted(doc_id)).cast("string").alias("id"), F.col(quoted(label)).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").drop("high")
    # The share is a little larger than asked for; the limit then cuts few rows, whatever the number of labels.
    place, share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)), min(1.0, 1.1 * rows / max(1, known.count()))
    chosen = known.where(place < int(share * 1_000_000)).orderBy(place, "id").limit(rows)
    docs = df.select(F.col(quoted(doc_id)).cast("string").alias("doc"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    found = docs.join(F.broadcast(chosen), docs["doc"] == chosen["id"]).select("id", "text", "label")
    least = found.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return least.select("id", "least.text", "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """The usual first-order steps, in place."""

    def __init__(self, params: list[np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
