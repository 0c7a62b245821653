"""License scans by diagonal voting.

All rolling k-gram hashes of a text's words are joined with the positions of the same k-grams in license templates,
a broadcast table of fixed size. A hit at word i of the text and word j of a template votes for the diagonal i - j;
votes are summed by diagonal, neighbouring diagonals (where words were put in or left out) are merged into spans,
and a span is verified on its order and its extent: it counts the different k-grams of the template that stand in it
in the template's order, and where it reaches further than twice the template, only those of its best diagonal. A
phrase to be found exactly is a template whose every k-gram must vote on one diagonal. K-grams meet by 64-bit
hashes: with some 300 of them in the templates, no false hit is likely in 10^13 words. DataFrame functions only;
texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import Scratch, ascii_lower, quoted

#: Words: letters and digits of ASCII, and all beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Base phrases, found exactly, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening passages of public license texts and notices, found in part; label, text.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
)
#: How far diagonals of one span may lie apart, and the share of a template's k-grams that a span must hold.
DRIFT, COVERAGE = 8, 0.6
#: k-grams of templates that are broadcast at once; a larger library takes a pass over the texts for each so many.
GRAMS = 1 << 16


def words_of(text: Column) -> Column:
    """array<string>: the lower-cased words of a text."""
    plain = F.btrim(F.regexp_replace(ascii_lower(text), NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def portions(templates: tuple[tuple[str, str, bool], ...], k: int = K) -> list[tuple[int, tuple[tuple[str, str, bool], ...]]]:
    """The templates in runs of at most GRAMS k-grams, or of one template, each with the number of its first."""
    out: list[tuple[int, tuple[tuple[str, str, bool], ...]]] = []
    room = 0
    for number, template in enumerate(templates):
        n = len(template[1].split()) - k + 1
        if not out or n > room:
            out.append((number, ()))
            room = GRAMS
        out[-1] = (out[-1][0], (*out[-1][1], template))
        room -= n
    return out


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str, bool], ...], k: int = K, first: int = 0) -> DataFrame:
    """(h, template, at, need, exact, label): one row for each k-gram of each (label, text, exact), numbered from ``first``."""
    rows = []
    for number, (label, text, exact) in enumerate(templates, first):
        w = text.split()
        rows += [f"('{' '.join(w[i : i + k])}', {number}, {i}, {len(w) - k + 1}, {str(exact).lower()}, '{label}')" for i in range(len(w) - k + 1)]
    grams = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(gram, template, at, need, exact, label)")
    return grams.select(F.xxhash64(*(F.split("gram", " ")[j] for j in range(k))).alias("h"), "template", "at", "need", "exact", "label")


def votes(df: DataFrame, words: Column, templates: tuple[tuple[str, str, bool], ...], k: int = K) -> DataFrame:
    """Rows (id, tag, n_words) of ``df`` (id, tag, ...), one each with i = -1, and one more for each hit (i, template, ...).

    One flow, so that a text's words are made once: the row itself travels as a gram that no template has.
    """
    n = F.size(words)
    none = F.lit(None).cast("long")
    itself = F.array(F.struct(F.lit(-1).alias("i"), none.alias("h"), n.alias("n")))
    rolling = F.transform(F.slice(words, 1, F.greatest(n - (k - 1), F.lit(0))), lambda w, i: F.struct(i.alias("i"), F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k))).alias("h"), F.lit(None).cast("int").alias("n")))
    each = df.select("id", "tag", F.inline(F.concat(itself, rolling)))
    out = None
    for first, some in portions(templates, k):
        met = each.join(F.broadcast(template_grams(df.sparkSession, some, k, first)), "h", "left").where("i = -1 OR template IS NOT NULL")
        met = met.select("id", "tag", F.col("n").cast("long").alias("n_words"), "i", "template", "at", "need", "exact", "label")
        out = met if out is None else out.union(met.where("i >= 0"))
    return out


def spans(hits: DataFrame, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """(doc, label, exact, start, votes, need): each verified place of each template.

    ``start`` is the word at which the template's first word stands or would stand; 0 at least.
    """
    of = ("doc", "template", "label", "exact", "need")
    diagonals = hits.groupBy(*of, (F.col("i") - F.col("at")).alias("diagonal")).agg(F.collect_set(F.struct("i", "at")).alias("hits"))
    # Diagonals in order, a new span where two lie more than ``drift`` apart; each diagonal of an exact phrase is a
    # span of its own.
    order = Window.partitionBy("doc", "template").orderBy("diagonal")
    apart = F.when(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > drift), 1).otherwise(0)
    merged = (
        diagonals.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(order))
        .groupBy(*of, "span").agg(F.min("diagonal").alias("diagonal"), F.max(F.size("hits")).alias("best"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    )
    x = F.col("hits")
    extent = F.element_at(x, -1)["i"] - x[0]["i"] + 1
    # In order: the steps from hit to hit that go forward in the template, and the first; repeats count once.
    forward = F.size(F.filter(F.transform(x, lambda y, j: (j > 0) & (y["at"] > F.get(x, j - 1)["at"])), lambda y: y)) + 1
    found = F.when(extent <= 2 * F.col("need"), F.least(forward, F.size(F.array_distinct(F.transform(x, lambda y: y["at"]))))).otherwise(F.col("best"))
    return (
        merged.withColumn("votes", found)
        .where(F.col("votes") >= F.when(F.col("exact"), F.col("need")).otherwise(coverage * F.col("need")))
        .select("doc", "label", "exact", F.greatest(F.col("diagonal"), F.lit(0)).alias("start"), "votes", "need")
    )


def license_scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the exact phrases, first_word and last_word are the least and greatest word at
    which one starts (null where none does); base_labels are their labels, labels those of any span; score is the
    largest share of a template found, 1 for an exact phrase, 0 for none. Null and empty texts have no words.
    Rows that repeat an id and a text get the same result each; a null id is an id like any other. An empty table
    gives an empty one. The result reads a table of the shared scratch folder.
    """
    every = (*((label, p, True) for p, label in phrases.items()), *((label, t, False) for label, t in templates))
    own = df.select(F.col(quoted(doc_id)).alias("id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    own = own.select("id", F.xxhash64("text").alias("tag"), words_of(F.col("text")).alias("words"))
    met = Scratch(df.sparkSession, "licenses").save(votes(own, F.col("words"), tuple(every)), "votes")
    found = (
        spans(met.where("i >= 0").withColumn("doc", F.struct("id", "tag")))
        .groupBy("doc").agg(
            F.count_if("exact").alias("n_base"),
            F.min(F.when(F.col("exact"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("exact"), F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
            F.max(F.col("votes") / F.col("need")).alias("score"),
        )
        .select(F.col("doc.id").alias("found_id"), F.col("doc.tag").alias("found_tag"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
    rows = met.where("i = -1").select("id", "tag", "n_words")
    return rows.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("tag") == F.col("found_tag")), "left").select(
        F.col("id").alias(doc_id), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
