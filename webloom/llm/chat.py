"""Chat formatting by prefix-target expansion.

A conversation's turns are put in order and marked by a template; every assistant turn then becomes an example of
its own: all turns before it as context, and only its text under the loss mask. Control strings inside texts are
escaped, reversibly, so that no text can open or close a turn. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import quoted

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """One more backslash between < and |: "<|" becomes "<\\|", "<\\|" becomes "<\\\\|", and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role in one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_examples(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", assistant: str = "assistant") -> DataFrame:
    """(conv_id, target, n_context, formatted, loss_start, loss_chars): one row per assistant turn.

    ``formatted`` holds all turns up to the target, which is number ``target`` (from 0) of the conversation;
    its escaped text is the ``loss_chars`` code points from ``loss_start`` (0-based) on. Where a conversation does
    not end with an assistant turn, one more row of no loss (target null) holds the whole conversation, so that
    no turn is lost. Null texts and roles are empty; turns of equal or null number stand in the order of role and
    text, nulls first; repeated rows are turns of their own. Other columns are left out. An empty table gives none.
    Each example repeats its context, so a conversation's examples grow with the square of its turns: that is what
    the expansion is. A conversation is one row until it is exploded, and must fit into one.
    """
    clean = df.select(F.col(quoted(conv_id)).alias("conv"), F.struct(F.col(quoted(turn)).alias("n"), F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")).alias("turn"))
    whole = clean.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = whole.select("conv", F.transform("turns", lambda t: F.struct(
        (t["role"] == assistant).alias("target"),
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"),
    )).alias("turns"))
    last = F.size("turns") - 1
    wanted = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(F.col("turns"), i)["target"] | (i == last))
    marked = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    each = whole.select("conv", marked.alias("marked"), "turns", F.explode(wanted).alias("i")).select(
        "conv", "i", F.get("turns", F.col("i")).alias("t"), F.array_join(F.slice("marked", 1, F.col("i")), "").alias("context"),
    )
    is_target = F.col("t.target")
    return each.select(
        F.col("conv").alias(conv_id),
        F.when(is_target, F.col("i")).alias("target"),
        F.when(is_target, F.col("i")).otherwise(F.col("i") + 1).alias("n_context"),
        F.concat("context", "t.head", "t.body", F.lit(END)).alias("formatted"),
        F.when(is_target, F.length("context") + F.length("t.head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(is_target, F.length("t.body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring_index(F.substring(p, len(START) + 1, 2**31 - 1), "\n", 1)).alias("role"),
        unescape(p.substr(F.instr(p, F.lit("\n")) + 1, F.length(p))).alias("text"),
    ))


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(formatted.substr(start.cast("int") + 1, chars.cast("int")))
