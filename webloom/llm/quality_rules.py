"""Quality rules as a short-circuit cascade.

Each rule is a SQL condition that rejects a document. Its cost (time a row) and its selectivity (share of rows that
it rejects, of those that the free rules pass) are estimated on a sample; the rules are then ordered by rejection per cost and evaluated one
by one: what a rule reads is computed only for documents that no earlier rule has rejected. The order changes what
is computed, never the verdict. Metrics that a caller wants of all documents are computed for all, and rules that
read these alone are free. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import SPACE, fresh, quoted

#: Rows on which costs and selectivities are estimated; they decide the order of the rules, not the verdict.
SAMPLE_ROWS = 500
SYMBOLS = "[#*$%&|<>]"
GAP = r"[\x20\x09-\x0D]+"
#: A letter and the rest of its word: each word that has a letter holds one match.
LETTERED = r"[^\x00-\x40\x5B-\x60\x7B-\x7F][^\x20\x09-\x0D]*"
#: What the base rules read, and what later rules read, each only for documents that no rule before has rejected.
BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
LATER = ("n_digits", "n_distinct", "n_cut_lines", "n_bullet_lines", "n_no_letter")
METRICS = BASE + LATER


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over metric columns; ``needs`` are the metrics that it reads."""

    name: str
    rejects: Column
    needs: tuple[str, ...] = METRICS


def words_of(text: Column) -> Column:
    """array<string>: the words [^\\x20\\x09-\\x0D]+ of a text."""
    plain = F.btrim(text, F.lit(SPACE))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, GAP))


def windows(words: Column) -> Column:
    """array<struct<h, i>>: a 64-bit hash of each 3-word window, and its position."""
    n = F.size(words)
    return F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))


def measured(df: DataFrame, text: str = "text", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """``df`` with the ``metrics`` (long) of ``text``; null counts as empty.

    n_lines: lines, the empty ones too. n_dup_lines: lines with a word that equal an earlier one. n_repeat_words:
    words inside 3-word windows that the text has twice or more. n_digits: 0-9. n_distinct: different words.
    n_cut_lines, n_bullet_lines: lines that end in ..., and that start with a bullet. n_no_letter: words without
    any of a-z, A-Z and characters beyond ASCII.
    """
    c = fresh(df, "text", "words", "windows", "hits")
    spaces = F.lit(SPACE)
    t, words = F.col(c["text"]), F.col(c["words"])
    out = df.withColumn(c["text"], F.coalesce(F.col(quoted(text)), F.lit("")))
    out = out.withColumn(c["words"], words_of(t))
    each = F.split(t, "\n", -1)
    lines = F.filter(each, lambda x: F.btrim(x, spaces) != "")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))  # noqa: E731  several times cheaper than translate
    out = out.withColumns({
        "n_words": F.size(words),
        "word_chars": F.length(F.regexp_replace(t, GAP, "")),
        "n_symbols": count(SYMBOLS),
        "n_lines": F.size(each),
        "n_dup_lines": F.when(F.contains(t, F.lit("\n")), F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0),
        "n_digits": count("[0-9]"),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_cut_lines": F.size(F.filter(each, lambda x: F.btrim(x, spaces).endswith("..."))),
        "n_bullet_lines": F.size(F.filter(each, lambda x: F.ltrim(x, spaces).rlike("^[-*\u2022]"))),
        "n_no_letter": F.size(words) - count(LETTERED),
        c["windows"]: F.sort_array(windows(words)),
    })
    # n_repeat_words: words inside windows that the text has twice or more, the first time included. Sorted by
    # hash, equal windows meet; each that equals a neighbour covers three positions from its own on.
    w = F.col(c["windows"])
    hits = F.filter(w, lambda x, k: (x["h"] == F.get(w, k - 1)["h"]) | (x["h"] == F.get(w, k + 1)["h"]))
    out = out.withColumn(c["hits"], F.transform(hits, lambda x: x["i"]))
    h = F.col(c["hits"])
    covered = F.size(F.array_distinct(F.concat(h, F.transform(h, lambda i: i + 1), F.transform(h, lambda i: i + 2))))
    out = out.withColumn("n_repeat_words", F.when(F.size(h) > 0, covered).otherwise(0))
    # A generator between metrics and what uses them: the optimizer would else copy their expressions into each
    # filter on a verdict, nested as they are, and take forever.
    return out.select(*(F.col(quoted(x)) for x in df.columns if x not in METRICS), F.inline(F.array(F.struct(*(F.col(m).cast("long").alias(m) for m in metrics)))))


#: The production rules. Base: too few words, and too many words in repeated windows; and, by the same metrics, markup
#: debris, repeated lines and words of no natural length. Later: digits, few different words, cut and bullet lines,
#: words without letters.
def default_rules() -> list[Rule]:
    n = F.col("n_words")
    return [
        Rule("few_words", n < 50, ("n_words",)),
        Rule("repetition", 100 * F.col("n_repeat_words") > 50 * n, ("n_words", "n_repeat_words")),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n, ("n_words", "n_symbols")),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), ("n_lines", "n_dup_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n), ("n_words", "word_chars")),
        Rule("digits", 100 * F.col("n_digits") > 30 * F.col("word_chars"), ("word_chars", "n_digits")),
        Rule("few_distinct", 20 * F.col("n_distinct") < n, ("n_words", "n_distinct")),
        Rule("cut_lines", 10 * F.col("n_cut_lines") > 3 * F.col("n_lines"), ("n_lines", "n_cut_lines")),
        Rule("bullet_lines", 10 * F.col("n_bullet_lines") > 9 * F.col("n_lines"), ("n_lines", "n_bullet_lines")),
        Rule("no_letters", 10 * F.col("n_no_letter") > 5 * n, ("n_words", "n_no_letter")),
    ]


def _nanos(after: Column) -> Column:
    """The clock of the machine that computes the row, read once ``after`` is known."""
    return after * 0 + F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def ordered(df: DataFrame, rules: list[Rule], text: str = "text", free: tuple[Rule, ...] = (), sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejection per cost among the rows that the ``free`` rules pass, the cheaper first among equals.

    Up to ``sample_rows`` rows, chosen by a hash of the text, go through all rules in one job that reads the clock
    around each. What a rule reads is measured for it alone.
    """
    share = min(1.0, 2 * sample_rows / max(1, df.count()))
    some = df.select(F.col(quoted(text)).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))
    if free:
        some = measured(some, "text", tuple(m for m in METRICS if any(m in r.needs for r in free))).where(~F.coalesce(F.greatest(*(r.rejects for r in free), F.lit(False)), F.lit(False))).select("text")
    out, done = some.limit(sample_rows), F.lit(0)
    for i, rule in enumerate(rules):
        out = measured(out.withColumn(f"a{i}", _nanos(done)), "text", rule.needs)
        out = out.withColumn(f"r{i}", F.coalesce(rule.rejects, F.lit(False)).cast("int")).drop(*rule.needs)
        out = out.withColumn(f"b{i}", _nanos(F.col(f"r{i}")))
        done = F.col(f"b{i}")
    row = out.agg(*(F.sum(F.col(f"b{i}") - F.col(f"a{i}")).alias(f"cost{i}") for i in range(len(rules))), *(F.sum(f"r{i}").alias(f"out{i}") for i in range(len(rules)))).first()
    value = {r.name: ((row[f"out{i}"] or 0) / max(row[f"cost{i}"] or 1, 1), -(row[f"cost{i}"] or 1)) for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: value[r.name], reverse=True)


def quality_cascade(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", into: str = "kept", report: tuple[str, ...] = (), trace: bool = False, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with ``into``: whether a document passes all rules.

    ``report`` names metrics that all documents are to get; rules that read no others cost nothing more and come
    first. The other rules follow by rejection per cost, each measured only for documents that all rules before it
    have passed. With ``trace`` what they measured is returned too, null where it was not: which of a rejected
    document's are null hangs on the order, hence on the sample and the clock; ``into`` and the report never do.
    Columns of ``df`` that are named as an output are replaced. Null and empty texts have no words and fall to the
    word count. Rows are judged one by one: repeated rows get the same verdict, an empty table gives an empty one.
    """
    rules = rules if rules is not None else default_rules()
    free = [r for r in rules if set(r.needs) <= set(report)]
    costly = [r for r in rules if r not in free]
    costly = ordered(df, costly, text, tuple(free), sample_rows) if len(costly) > 1 else costly
    passes = lambda rs: F.coalesce(~F.greatest(*(r.rejects for r in rs), F.lit(False)), F.lit(True)) if rs else F.lit(True)
    known = [m for m in METRICS if m in report]
    traced = [m for m in METRICS if m not in report and any(m in r.needs for r in costly)] if trace else []
    # The input's columns are put aside meanwhile, so that no name clashes; "left" is the text still to be judged.
    outside = F.struct(*(F.col(quoted(x)).alias(f"c{i}") for i, x in enumerate(df.columns)))
    out = df.select(outside.alias("row"), F.col(quoted(text)).alias("left"))
    out = measured(out, "left", tuple(known)) if known else out
    out = out.select("row", "left", *known, passes(free).alias("ok"), *(F.lit(None).cast("long").alias(f"t_{m}") for m in traced))
    for rule in costly:
        own = tuple(m for m in rule.needs if m not in known)
        out = out.withColumn("left", F.when(F.col("ok"), F.col("left"))).withColumnsRenamed({m: f"k_{m}" for m in known})
        out = measured(out, "left", own).withColumnsRenamed({f"k_{m}": m for m in known})
        was = F.col("ok")
        out = out.select(
            "row", "left", *known, (was & passes([rule])).alias("ok"),
            *((F.when(was, F.col(m)).otherwise(F.col(f"t_{m}")) if m in own else F.col(f"t_{m}")).alias(f"t_{m}") for m in traced),
        )
    new = {**{m: F.col(m) for m in known}, **{m: F.col(f"t_{m}") for m in traced}, into: F.col("ok")}
    return out.select(*(F.col("row")[f"c{i}"].alias(x) for i, x in enumerate(df.columns) if x not in new), *(v.alias(k) for k, v in new.items()))
