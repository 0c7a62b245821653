"""Fill-in-middle transformation over a run-length encoding of character classes.

A batch of texts is stored as its maximal runs of one class, with the cumulative number of units up to each run. A
cut after a number of units is found by binary search of the run that holds it, and its offset follows by arithmetic:
the run's start and so many steps of the class's width. No list of tokens is made, whatever a text's length.

Units are words (white space goes with the word that follows it, or stands alone at the end), or characters. For
words a class is white or not, and a run of words is one unit as wide as itself; for characters a class is the
number of bytes of a character, and a run has as many units as characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import words
from webloom.llm.common import columns, fresh, quoted

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents those that are transformed, and of 100 transformed those whose suffix comes first.
RATE, SPM_RATE = 50, 80
#: Bytes of texts that are encoded at once; a longer text is encoded alone.
SLICE = 1 << 21

_FIELDS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
_TYPE = "n long, form string, prefix_chars long, middle_chars long, output string"
#: Bytes of a UTF-8 character by its first byte; 0 for the bytes that go on.
_WIDTH = np.zeros(256, np.uint8)
_WIDTH[:0x80], _WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 1, 2, 3, 4


class Runs:
    """The class runs of texts: start, step, and the sums of units and characters before and up to each.

    ``bounds`` are the texts' first runs, ``base`` and ``chars_base`` what comes before each text.
    """

    def __init__(self, texts: list[bytes], unit: str = "word") -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        firsts = ends - [len(t) for t in texts]
        if unit == "word":
            kind = words.WHITE[data].view(np.uint8)
        else:
            kind = _WIDTH[data]
            lead = np.flatnonzero(kind)
            kind = np.repeat(kind[lead], np.diff(np.append(lead, len(data))))  # a character's bytes are of its class
        new = np.zeros(len(data) + 1, bool)
        new[1:-1] = kind[1:] != kind[:-1]
        new[firsts] = True
        new[-1] = False
        self.start = np.flatnonzero(new)
        stop = np.append(self.start[1:], len(data))
        size, kind = stop - self.start, kind[self.start]
        if unit == "word":
            last = np.zeros(len(data) + 1, bool)
            last[ends] = True
            units = ((kind == 0) | last[stop]).astype(np.int64)
            self.step = size
            begins = np.zeros(len(data) + 1, np.int32)
            np.cumsum(_WIDTH[data] > 0, out=begins[1:], dtype=np.int32)
            chars = np.diff(begins[np.append(self.start, len(data))]).astype(np.int64)
        else:
            self.step = kind.astype(np.int64)
            units = chars = size // np.maximum(self.step, 1)
        self.unit = unit
        self.units = np.concatenate([[0], np.cumsum(units)])
        self.chars = np.concatenate([[0], np.cumsum(chars)])
        self.bounds = np.searchsorted(self.start, np.append(firsts, len(data)))
        self.firsts = firsts

    def counts(self) -> np.ndarray:
        """Units of each text."""
        return self.units[self.bounds[1:]] - self.units[self.bounds[:-1]]

    def cut(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, character) offset in each text at which its first ``units`` units end."""
        base = self.units[self.bounds[:-1]]
        run = np.searchsorted(self.units[1:], base + units)  # the first run by whose end that many units are there
        run = np.minimum(run, max(len(self.start) - 1, 0))
        some = units > 0
        if not some.any():
            return np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        into = base + units - self.units[run]
        at = self.start[run] + into * self.step[run] - self.firsts
        chars = (self.chars[run + 1] if self.unit == "word" else self.chars[run] + into) - self.chars[self.bounds[:-1]]
        return np.where(some, at, 0), np.where(some, chars, 0)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > SLICE:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def transformed(texts: list[bytes], h: np.ndarray, unit: str, marks: tuple[bytes, bytes, bytes], rate: int, spm_rate: int) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text; ``h`` has four random numbers for each."""
    runs = Runs(texts, unit)
    n = runs.counts()
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    (a, a_chars), (b, b_chars) = runs.cut(np.minimum(one, two)), runs.cut(np.maximum(one, two))
    p, s, m = marks
    out = []
    for i, t in enumerate(texts):
        if not t or h[i, 2] % 100 >= rate or any(x in t for x in marks):
            out.append((int(n[i]), "plain", None, None, t))
            continue
        prefix, middle, suffix = t[: a[i]], t[a[i] : b[i]], t[b[i] :]
        spm = h[i, 3] % 100 < spm_rate
        made = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
        out.append((int(n[i]), "spm" if spm else "psm", int(a_chars[i]), int(b_chars[i] - a_chars[i]), made))
    return out


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "word", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``df`` with n, form, prefix_chars, middle_chars and output; columns of these names are replaced.

    Of n units of the whole text the prefix ends after the smaller of two random numbers up to n, the middle after
    the larger, and the suffix is the rest. Outputs are the text (form plain), prefix, suffix and middle (psm) or
    suffix, prefix and middle (spm), each part after its mark. Randomness is the sha256 of ``seed``, a colon and the
    id as text (a null id: nothing), so rows that repeat an id are cut by the same numbers and nothing hangs on the
    layout. A text that is null, empty or holds a mark is plain, and so are ``100 - rate`` of 100 others; of the
    rest ``spm_rate`` of 100 are spm. Null texts have n 0 and an empty output. prefix_chars and middle_chars count
    code points and are null for plain texts. ``unit`` is word or char. Memory is a few times that of SLICE bytes or
    of the longest text. An empty table gives an empty one.
    """
    if unit not in ("word", "char") or len(set(marks)) < 3 or "" in marks:
        raise ValueError("unit is word or char, and marks are three different texts")
    coded = tuple(m.encode() for m in marks)

    @F.arrow_udf(_TYPE)
    def made(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for column, *numbers in batches:
            h = np.column_stack([x.to_numpy(zero_copy_only=False) for x in numbers]).astype(np.int64)
            texts = words.as_bytes(column)
            rows = [x for a, b in _slices(texts) for x in transformed(texts[a:b], h[a:b], unit, coded, rate, spm_rate)]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.binary() if name == "output" else kind).cast(kind) for k, (name, kind) in enumerate(_FIELDS)], [name for name, _ in _FIELDS])

    names = fresh(df, "hash", "made")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(names["hash"], 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    out = df.withColumn(names["hash"], digest)
    out = out.withColumn(names["made"], made(F.coalesce(F.col(quoted(text)), F.lit("")), *numbers))
    given = {name for name, _ in _FIELDS}
    return out.select(*(c for c, name in zip(columns(df), df.columns, strict=True) if name.lower() not in given), F.col(f"{names['made']}.*"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text from an output and its form. No text with a mark is transformed, so the parts split at the marks."""
    parts = F.split(output, "|".join(r"\Q" + m + r"\E" for m in marks))
    put = lambda *at: F.concat(*(F.get(parts, F.lit(i)) for i in at))
    return F.when(form == "plain", output).when(form == "psm", put(1, 3, 2)).otherwise(put(2, 3, 1))
