"""Line dedup: drops lines that many documents share.

Lines are exploded, normalised and hashed; documents are counted per hash; lines over the threshold go, except in
the document of the largest id; the rest is put together by position. DataFrame functions only.

Only (document, position, hash) travel, never a line's text: counting needs the hashes of the lines that are long
enough, and the positions to drop come back per document. A line in a third of all documents is counted by partial
sums in each task. To find the lines again, the hashes that hold more than one in HOT of all shared lines, fewer than
HOT in number whatever the input, are broadcast; all others are joined by a shuffle, to which the lines of broadcast
hashes go by keys of their own, so that none of them meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import SPACE, Scratch, ascii_lower, columns, fresh, quoted

#: Shared hashes that are broadcast, at most.
HOT = 10_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.btrim(line, F.lit(SPACE))


def drop_shared_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``df`` with shared lines gone from ``text``, and the numbers of lines before and dropped.

    Lines are split at \\n. Keys of at least ``min_chars`` code points found in at least ``min_docs`` different
    documents lose all their lines but those of the largest id that holds them. Null and empty texts are one
    empty line and come back as ''. Rows that repeat an id are one document; a null id counts as no document
    (its lines go where others share them). Other columns stay; columns named as the two numbers are replaced. An empty
    table gives an empty one. The result reads a table of the shared scratch folder.
    """
    c = fresh(df, "id", "tag", "pos", "line", "key", "h1", "h2", "docs", "keeper", "drop", "lines")
    words = F.coalesce(F.col(quoted(text)), F.lit(""))
    # The tag tells apart rows that share an id but not their text.
    own = df.withColumn(c["tag"], F.xxhash64(words))
    lines = (
        own.select(F.col(quoted(doc_id)).alias("id"), F.col(c["tag"]).alias("tag"), F.posexplode(F.split(ascii_lower(words), "\n", -1)).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        # Two 64-bit hashes of different seeds: at 10^12 lines no two keys are likely to meet.
        .select("id", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    shared = (
        lines.groupBy("h1", "h2", "id").agg(F.lit(1))
        .groupBy("h1", "h2").agg(F.count("id").alias("docs"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
    )
    shared = Scratch(df.sparkSession, "lines").save(shared, "shared")
    bound = (shared.agg(F.sum("docs")).first()[0] or 0) / HOT
    hot = shared.where(F.col("docs") > bound).select("h1", "h2", F.col("keeper").alias("hot_keeper"))
    cold = shared.where(F.col("docs") <= bound).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "keeper")
    met = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    known = F.col("hot_keeper").isNotNull()
    met = met.withColumn("h1", F.when(known, F.xxhash64("id", "tag", "pos")).otherwise(F.col("h1")))
    met = met.join(cold, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left").withColumn("keeper", F.coalesce("hot_keeper", "keeper"))
    drop = (
        met.where(F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "tag").agg(F.collect_set("pos").alias(c["drop"]))
        .withColumnsRenamed({"id": c["docs"], "tag": c["keeper"]})
    )
    joined = own.join(drop, F.col(quoted(doc_id)).eqNullSafe(F.col(c["docs"])) & (F.col(c["tag"]) == F.col(c["keeper"])), "left")
    parts = F.split(words, "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(c["lines"]) - 1), c["drop"]), lambda i: F.get(F.col(c["lines"]), i)), "\n")
    out = joined.withColumn(c["lines"], parts).withColumns({
        n_lines: F.size(c["lines"]).cast("long"),
        n_dropped: F.coalesce(F.size(c["drop"]), F.lit(0)).cast("long"),
        text: F.when(F.col(c["drop"]).isNull(), words).otherwise(kept),
    })
    return out.select(*columns(df), *(x for x in (n_lines, n_dropped) if x not in df.columns))
