"""The corpus pipeline: five stages, each an operator of webloom.llm, over the documents of a data folder.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, decontam, jaccard, lines, queries, toxicity
from webloom.llm.common import Scratch, columns, read, without


#: Pre-tokens that a worker keeps: fewer than where encoding is all that it does, as workers live on through the stages.
CACHED = 60_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model, fitted on ``docs`` and the folder's labels, rejects."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that documents share; n_chars follows."""
    kept = lines.drop_shared_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id."""
    classes = jaccard.jaccard_classes(docs)
    gone = Scratch(spark, "near").save(classes.where("component_id <> doc_id").select("doc_id").distinct(), "ids")
    return without(docs, F.col("doc_id"), gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that cover a benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding the ids gives the text back."""
    import public_tokenizers

    coded = bpe.bpe_roundtrip(docs.select("doc_id", "text"), queries.tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cached=CACHED)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("same"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: No SQL: the first stage is a trained model, the last a tokenizer. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the folder's documents. Each table goes once the next one is written."""
    own, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = own.save(docs, f"stage{number}")
        if 0 < number < len(STAGES) - 1:
            own.drop(f"stage{number - 1}")
    return docs
