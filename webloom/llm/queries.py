"""The queries of this subpackage's operators: thin callables that apply each to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, chat, decontam, fill_in_middle, hard_negatives, jaccard, licenses, lines, quality_model, quality_rules, tokens, toxicity, warc
from webloom.llm.common import Scratch, read
from webloom.llm.labelled import held_out


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def hexdigest(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    judged = quality_rules.quality_cascade(docs, report=quality_rules.BASE)
    n = F.col("n_words")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"), "kept",
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_model.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_model.score(docs, model).alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(more)
    loss = chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))
    # Only the last row of a conversation is read back whole; of the others the reply and the length.
    last = F.max_by("formatted", "n_context")
    read_back = chat.format_examples(turns).groupBy("conv_id").agg(
        last.alias("whole"), F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", loss.alias("text"))))).alias("loss"), F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    out = read_back.select("conv_id", chat.read_turns(F.col("whole")).alias("turns"), F.array_join("loss.text", "").alias("loss"), "formatted_chars")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        hexdigest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), hexdigest(F.col("loss")).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.bpe_roundtrip(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), hexdigest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), hexdigest(F.col("decoded")).alias("decoded_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_shared_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", hexdigest(F.col("text")).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(docs, model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", "over_limit")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents", "doc_id", "text"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hexdigest(F.col("output")).alias("output_sha256"), hexdigest(back).alias("restored_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").path
    warc.write(read(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    return warc.resolved(warc.salvage(spark, folder)).drop("found")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_quality_model, op4_chat_format, op5_jaccard_join, op6_bpe_roundtrip, op7_line_dedup, op8_toxicity, op9_license_scan, op10_token_counts, op11_fill_in_middle, op12_hard_negatives, op13_warc)}


#: [\x20\x09-\x0D] in DuckDB's strings.
_SP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, string_split(text, chr(10)) AS l FROM d),
g AS (SELECT doc_id, p, w[p:p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM r, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines,
    (len(list_filter(l, lambda x: trim(x, {_SP}) <> '')) - len(list_distinct(list_filter(l, lambda x: trim(x, {_SP}) <> ''))))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, len(list_distinct(w)) AS n_distinct,
    len(list_filter(l, lambda x: ends_with(trim(x, {_SP}), '...'))) AS n_cut_lines, len(list_filter(l, lambda x: regexp_matches(ltrim(x, {_SP}), '^[-*\u2022]'))) AS n_bullet_lines,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]'))) AS n_no_letter
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_digits > 30 * word_chars OR 20 * n_distinct < n_words OR 10 * n_cut_lines > 3 * n_lines OR 10 * n_bullet_lines > 9 * n_lines OR 10 * n_no_letter > 5 * n_words) AS kept
FROM m
"""

OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, v.turn, v.role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  length('<|im_start|>') + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g')) + 1
  + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS c FROM t),
s AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, {_AZ.format(f"trim(line, {_SP})")} AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, keeper IS NOT NULL AND doc_id <> keeper AS dropped FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


_GRAMS = ", ".join(f"({n}, '{label}', '{text}', {str(exact).lower()})" for n, (label, text, exact) in enumerate((*((x, p, True) for p, x in licenses.PHRASES.items()), *((x, t, False) for x, t in licenses.TEMPLATES))))

OP9_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT template, label, string_split(text, ' ') AS w, exact FROM (VALUES {_GRAMS}) AS v(template, label, text, exact)),
tg AS (SELECT template, label, exact, len(w) - 2 AS need, j, w[j + 1:j + 3] AS g FROM (SELECT *, unnest(range(len(w) - 2)) AS j FROM t)),
dg AS (SELECT doc_id, i, w[i + 1:i + 3] AS g FROM (SELECT *, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
hits AS (SELECT doc_id, template, label, exact, need, i, j, i - j AS diagonal FROM dg JOIN tg USING (g)),
gaps AS (SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {licenses.DRIFT} THEN 1 ELSE 0 END AS apart
  FROM (SELECT doc_id, template, exact, diagonal, count(*) AS n FROM hits GROUP BY ALL)),
diagonals AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM gaps),
steps AS (SELECT hits.*, n, span, j > lag(j) OVER (PARTITION BY hits.doc_id, hits.template, span ORDER BY i, j) AS forward
  FROM hits JOIN diagonals USING (doc_id, template, diagonal)),
spans AS (SELECT doc_id, template, label, exact, need, span, greatest(min(diagonal), 0) AS start,
  CASE WHEN max(i) - min(i) + 1 <= 2 * need THEN least(count(*) FILTER (forward) + 1, count(DISTINCT j)) ELSE max(n) END AS votes
  FROM steps GROUP BY doc_id, template, label, exact, need, span),
s AS (SELECT * FROM spans WHERE votes >= CASE WHEN exact THEN need ELSE {licenses.COVERAGE} * need END),
f AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(votes::DOUBLE / need) AS score
  FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN f ON d.doc_id = f.doc_id
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM d),
c AS (SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS c2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(t[1:least(c1, c2)], '') AS prefix, array_to_string(t[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(t[greatest(c1, c2) + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id))::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
"""

OP13_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""
    return {"op1_quality_rules": OP1_SQL, "op4_chat_format": OP4_SQL, "op7_line_dedup": OP7_SQL, "op9_license_scan": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_warc": OP13_SQL}
