"""Token counts under a SentencePiece model, by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of frequent pre-tokens, tier two a bounded cache in each Python
worker that the library itself fills on a miss. No pre-token is ever shuffled: one pass over the texts finds the
frequent ones by a summary of fixed size per task, a second one looks up, and one number per row comes back.

A pre-token is a space and what follows up to the next space. Cutting there is exact as long as no piece of the
vocabulary has a word-start mark after another character; the model's pieces are checked for that when it is
loaded, and a model that fails has its texts encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import quoted

#: Entries of the broadcast table, and of each worker's cache, at most.
FREQUENT, CACHED = 50_000, 200_000
#: Entries of a task's own table of frequent pre-tokens, and tasks that add these tables up.
A_TASK, MERGERS = 8_192, 16
MARK = "▁"
_ODD = re.compile(f"[\n\x00{MARK}]")
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_open: dict[str, Counter_] = {}


class Counter_:
    """Counts tokens of texts with one model; keeps a bounded cache."""

    def __init__(self, model: str, frequent: dict[str, int] | None = None, cached: int = CACHED) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        pieces = [p for i, p in enumerate(pieces) if not self.model.is_control(i) and not self.model.is_unknown(i)]
        self.cut = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self.model.encode("a", out_type=str) == self._of(MARK + "a")
        #: New lines stand alone where no piece holds one; each is then as many tokens as here.
        self.lines = self.cut and not any("\n" in p for p in pieces)
        self.line = len(self.model.encode("\n")) - 1
        self.first = dict(frequent or {})
        self.cache: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.cached = cached

    def _of(self, run: str) -> list[str]:
        """The pieces of a run that starts with a mark, which the library adds itself."""
        return self.model.encode(run[1:], out_type=str)

    def _bare(self, part: str) -> int:
        """Tokens of what follows a new line."""
        return len(self.model.encode("\n" + part)) - self.line - 1 if part else 0

    def _length(self, word: str) -> int:
        """Tokens of a mark and ``word`` (which has no mark)."""
        if not word:
            return 1
        if self.lines and "\n" in word:
            head, *tail = word.split("\n")
            return self.word(head) + sum(self.line + (self.bare(x) if x else 0) for x in tail)
        return len(self.model.encode(word))

    def bare(self, part: str) -> int:
        """As ``_bare``; its cache is its own, as a word may look like any key that could be made of a part."""
        n = self.tails.get(part)
        if n is None:
            n = self._keep(self.tails, part, self._bare(part))
        return n

    def word(self, word: str) -> int:
        n = self.first.get(word)
        if n is None:
            n = self.cache.get(word)
        if n is None:
            n = self._length(word)
            if "\n" not in word:
                self._keep(self.cache, word, n)
        return n

    def _keep(self, cache: dict[str, int], key: str, n: int) -> int:
        if len(key) <= 64:
            if len(cache) >= self.cached:
                cache.clear()
            cache[key] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cut:
            return len(self.model.encode(text))
        if "  " in text or text[0] == " " or MARK in text:
            return sum(self._run(x) for x in _RUNS.findall(MARK + text.replace(" ", MARK)))
        words = text.split(" ")
        found = list(map(self.first.get, words))
        if None not in found:
            return sum(found)
        return sum(n if n is not None else self.word(w) for n, w in zip(found, words, strict=True))

    def _run(self, run: str) -> int:
        if run == MARK:
            return 1
        return self.word(run[1:]) if run[1] != MARK else len(self.model.encode(run[1:]))


def counter(model: str, packed: tuple[str, bytes] | None) -> Counter_:
    """This worker's counter for a model; it outlives a task."""
    if model not in _open:
        words, lengths = packed or ("", b"")
        _open.clear()
        _open[model] = Counter_(model, dict(zip(words.split("\x00"), lengths, strict=True)) if lengths else None)
    return _open[model]


def _pack(seen: Counter[str], most: int) -> pa.RecordBatch:
    top = seen.most_common(most)
    return pa.RecordBatch.from_arrays([pa.array(["\x00".join(w for w, _ in top)], pa.large_string()).cast(pa.string()), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["words", "counts"])


def _kept(seen: Counter[str], most: int) -> Counter[str]:
    """At most ``most`` words: the most frequent ones, once there are eight times as many."""
    return seen if len(seen) <= 8 * most else Counter(dict(seen.most_common(most)))


def _tally(most: int):
    """The most frequent pre-tokens of a task's texts: one row of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                for t in batch.column(0).slice(a, 64).to_pylist():
                    seen.update((t or "").split(" "))
                seen = _kept(seen, most)
        yield _pack(Counter({w: n for w, n in seen.items() if n > 1 and len(w) <= 64 and not _ODD.search(w)}), most)

    return run


def _merged(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update(dict(zip(words.split("\x00"), counts, strict=True)) if counts else {})
                seen = _kept(seen, most)
        yield _pack(seen, most)

    return run


def _sized(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter_(model)
        for batch in batches:
            for words in batch.column(0).to_pylist():
                sized = [(w, n) for w, n in ((w, own.word(w)) for w in filter(None, words.split("\x00"))) if n < 256]
                yield pa.RecordBatch.from_pydict({"words": ["\x00".join(w for w, _ in sized)], "lengths": [bytes(n for _, n in sized)]})

    return run


def frequent_lengths(df: DataFrame, text: str, model: str, frequent: int = FREQUENT, a_task: int = A_TASK) -> tuple[str, bytes]:
    """The first tier in compact form: words joined by NUL, and a byte of length for each.

    Counted over all texts: each task gives the ``a_task`` pre-tokens that are most frequent in its own, ``MERGERS``
    tasks add these rows up, and one the sums. What travels is a row of bounded size per task, never a pre-token of
    its own; what the driver gets is a table of at most ``frequent`` entries. A count may miss what a task has cut
    off: the table decides speed alone.
    """
    kind = "words string, counts array<long>"
    rows = df.select(F.col(quoted(text)).alias("text")).mapInArrow(_tally(a_task), kind).repartition(MERGERS)
    best = rows.mapInArrow(_merged(frequent), kind).coalesce(1).mapInArrow(_merged(frequent), kind)
    row = best.mapInArrow(_sized(model), "words string, lengths binary").first()
    return (row.words, bytes(row.lengths)) if row and row.lengths else ("", b"")


def token_counts(df: DataFrame, text: str, model: str, frequent: int = FREQUENT) -> Column:
    """A column: the number of tokens of the whole text, as the library's default encoding has it.

    Null and empty texts have 0 tokens. Special strings inside a text are ordinary text.
    """
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, text, model, frequent))

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(model, table.value)
        for texts in batches:
            yield pd.Series([own.count(t) for t in texts], dtype="int64")

    return lengths(F.col(quoted(text)))


def count_tokens(df: DataFrame, model: str, text: str = "text", limit: int = 4096, into: str = "n_tokens", over: str = "over_limit") -> DataFrame:
    """``df`` with the token count of ``text`` and whether it passes ``limit``.

    Other columns stay as they are; a column named as an output is replaced. An empty table gives an empty one.
    """
    df = df.withColumn(into, token_counts(df, text, model))
    return df.withColumn(over, F.col(into) > limit)
