"""Many patterns against many texts: one automaton, whose cost hangs on the texts and not on how many patterns there are.

The automaton of a set of patterns is a table of states by bytes, made once and broadcast. A batch of texts goes
through it in lockstep, a byte of every text at a time. Sets whose table would be larger than LIMIT are split, and
each part gets a pass of its own, so that what is broadcast at once stays within the limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an automaton's table at most, and texts that go through it at once.
LIMIT, TEXTS = 32 << 20, 4096


class Automaton:
    """States by bytes; of each state the patterns that end there, as a list of lists in two arrays."""

    def __init__(self, patterns: Sequence[tuple[int, bytes]]) -> None:
        after: list[dict[int, int]] = [{}]
        own: list[list[int]] = [[]]
        for number, pattern in patterns:
            state = 0
            for byte in pattern:
                if byte not in after[state]:
                    after[state][byte] = len(after)
                    after.append({})
                    own.append([])
                state = after[state][byte]
            own[state].append(number)
        # A state that lacks a byte goes where its longest proper suffix goes; states by depth, so that this is known.
        self.next = np.zeros((len(after), 256), np.int32)
        suffix, level = [0] * len(after), [0]
        while level:
            deeper = []
            for state in level:
                self.next[state] = self.next[suffix[state]] if state else 0
                for byte, child in after[state].items():
                    suffix[child] = int(self.next[state, byte]) if state else 0
                    self.next[state, byte] = child
                    deeper.append(child)
            for child in deeper:
                own[child] += own[suffix[child]]
            level = deeper
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        self.ids = np.array([i for x in own for i in x], np.int64)

    def found(self, texts: Sequence[bytes], at_end: bool = False) -> list[list[int]]:
        """Of each text the patterns that stand in it, or that it ends with; each once, in order."""
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        start = (np.cumsum(size) - size)[order]
        state, rows, hits = np.zeros(len(texts), np.int32), [], []
        ends = self.first[1:] > self.first[:-1]
        left = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")  # texts with that many bytes, longest first
        if ends[0]:
            rows.append(np.arange(len(texts)))
            hits.append(np.zeros(len(texts), np.int32))
        for k, n in enumerate(left.tolist()):
            state[:n] = self.next[state[:n], data[start[:n] + k]]
            if not at_end and (at := np.flatnonzero(ends[state[:n]])).size:
                rows.append(at)
                hits.append(state[at])
        if at_end:
            at = np.flatnonzero(ends[state])
            rows, hits = [at], [state[at]]
        out: list[list[int]] = [[] for _ in texts]
        if rows:
            row, hit = np.concatenate(rows), np.concatenate(hits)
            pair = np.unique(np.column_stack([row, hit]), axis=0)
            for r, h in pair.tolist():
                out[order[r]] += self.ids[self.first[h] : self.first[h + 1]].tolist()
        return [sorted(set(x)) for x in out]


def parts(patterns: Sequence[bytes], limit: int = LIMIT) -> list[list[tuple[int, bytes]]]:
    """The numbered patterns in sets whose tables stay within ``limit`` bytes, or hold one pattern."""
    out: list[list[tuple[int, bytes]]] = [[]]
    room = limit
    for number, pattern in enumerate(patterns):
        cost = 1024 * len(pattern)
        if out[-1] and cost > room:
            out.append([])
            room = limit
        out[-1].append((number, pattern))
        room -= cost
    return out


def _finder(shared, at_end: bool):
    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out: list[list[int] | None] = []
            for a in range(0, len(column), TEXTS):
                some = column.slice(a, TEXTS)
                known = some.is_valid().to_pylist()
                made = shared.value.found(some.cast(pa.binary()).fill_null(b"").to_pylist(), at_end)
                out += [x if ok else None for x, ok in zip(made, known, strict=True)]
            yield pa.array(out, pa.list_(pa.int32()))

    return run


def matched(df: DataFrame, text: Column, patterns: Sequence[str], at_end: bool = False, into: str = "patterns", limit: int = LIMIT) -> DataFrame:
    """``df`` with the numbers of the ``patterns`` that stand in ``text``, or with ``at_end`` that it ends with: array<int>.

    Numbers are places in the list, ascending, each once. Case counts. A null text has a null; an empty pattern stands
    in every text. A list that is given twice the same pattern gets both numbers.
    """
    found = []
    for part in parts([p.encode() for p in patterns], limit):
        shared = df.sparkSession.sparkContext.broadcast(Automaton(part))
        found.append(_finder(shared, at_end))
    columns = [f(text) for f in found]
    return df.withColumn(into, columns[0] if len(columns) == 1 else reduce(lambda a, b: F.concat(a, b), columns))
