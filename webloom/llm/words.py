"""Vectorised word hashing: whole Arrow batches of texts to 64-bit word hashes, without a Python loop per word.

A word's hash is a polynomial over a random table of its bytes, modulo 2**64, taken from one running sum by
dividing out the power of its start; a final mix spreads the bits. Memory is bounded: texts go through in
pieces of about PIECE bytes, and a longer text is cut at separators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 18
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = (_rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2)) | _U(1)

#: Bytes that separate words: the white space of ASCII, or all of ASCII but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    size = 1 << max(19, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for b in (_BASE, _INVERSE):
            x = np.full(size, _U(b))
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[size] = (both[0], both[1])
    p, q = _powers[size]
    return p[:n], q[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def pieces(texts: list[bytes], separators: np.ndarray) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """(bytes, the texts' numbers, where each starts), in order; texts are joined by a new line."""
    cut = re.compile(b"[" + re.escape(bytes(np.flatnonzero(separators).astype(np.uint8))) + b"]")
    held: list[bytes] = []
    at: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if held and size + len(text) > PIECE:
            yield b"\n".join(held), at, list(np.cumsum([0, *(len(x) + 1 for x in held[:-1])]))
            held, at, size = [], [], 0
        pos = 0
        while len(text) - pos > PIECE:
            end = next((m.end() for m in [cut.search(text, pos + PIECE)] if m), len(text))
            yield text[pos:end], [k], [0]
            pos = end
        held.append(text[pos:] if pos else text)
        at.append(k)
        size += len(held[-1]) + 1
    if held:
        yield b"\n".join(held), at, list(np.cumsum([0, *(len(x) + 1 for x in held[:-1])]))


def spans(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.zeros(len(data) + 2, np.int8)
    np.logical_not(separators[data], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """The hash of each span of bytes; with ``lower``, A-Z count as a-z."""
    table = _TABLE.copy()
    if lower:
        table[65:91] = table[97:123]
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts])


def hashed_words(texts: list[bytes], separators: np.ndarray = WHITE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and the bounds of each text among them (one more than texts)."""
    out, counts = [], np.zeros(len(texts), np.int64)
    for raw, at, first in pieces(texts, separators):
        data = np.frombuffer(raw, np.uint8)
        starts, ends = spans(data, separators)
        out.append(hash_spans(data, starts, ends, lower))
        of = np.searchsorted(np.asarray(first), starts, "right") - 1
        np.add.at(counts, np.asarray(at), np.bincount(of, minlength=len(at)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k hashes; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += h[j : j + n] * _STEPS[j]
    return mix(total)


def shingle_sets(texts: list[bytes], k: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none an empty set."""
    h, bounds = hashed_words(texts, WHITE, lower)
    every = grams(h, k)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(mix(grams(h[a:b], int(b - a)) + _U(int(b - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def in_parts(column, rows: int = 256) -> Iterator[list[bytes]]:
    """The texts of an Arrow column, a few rows at a time."""
    for a in range(0, len(column), rows):
        yield as_bytes(column.slice(a, rows))


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    import pyarrow as pa

    return column.cast(pa.binary()).fill_null(b"").to_pylist()
