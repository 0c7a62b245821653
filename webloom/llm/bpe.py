"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pairs of a pre-token wait in buckets, one per merge rank, each a heap of linked-list positions. Two levels of
bitmaps tell which buckets are in use: the lowest set bit of the top word gives a leaf, the lowest set bit of the
leaf the next rank, so the next merge is found in constant time and a pre-token of n bytes takes O(n log n) at
worst, where a scan for the least rank takes O(n^2). Entries that a neighbour's merge has outdated are skipped.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import pack
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import fresh, quoted

#: Entries of each worker's cache of encoded pre-tokens, at most; and the longest pre-token that is kept.
CACHED, CACHED_CHARS = 300_000, 64
#: Bytes of one of the cache's two generations, at most, whatever the script; and what an entry takes in the dictionary.
CACHED_BYTES, ENTRY = 32 << 20, 50
_BITS = 8
_MASK = (1 << _BITS) - 1
_BIT = [1 << i for i in range(1 << _BITS)]
#: Bytes of text that are encoded at once: what a worker holds beside its cache and the Arrow batch that it got.
SLICE = 1 << 20


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[list[int]] | None = None) -> list[int]:
    """The ids of one pre-token: merges pairs by lowest rank, leftmost first, until no pair is in ``ranks``.

    The queue lives in local variables, as its calls would cost more than its work: ``buckets`` has the heap of
    positions of each rank in use, ``leaves`` and ``top`` are the two levels of bitmaps over the ranks. ``pairs``
    has the ranks of all pairs of bytes, -1 for none (see ``byte_pairs``).
    """
    get, bit = ranks.get, _BIT
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    pairs = pairs or byte_pairs(ranks)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    ids = [-1] * n  # what a merge has made of the bytes from here on; a rank is the id of what it makes
    wanted = [pairs[a][b] for a, b in zip(piece, piece[1:])]  # the rank of the pair that starts here
    wanted.append(-1)  # -1: none, or merged away
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(wanted):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(i)  # ascending, thus a heap
            else:
                buckets[rank] = [i]
                leaf = rank >> _BITS
                if leaf in leaves:
                    leaves[leaf] |= bit[rank & _MASK]
                else:
                    leaves[leaf] = bit[rank & _MASK]
                    top |= 1 << leaf
    while top:
        leaf = (top & -top).bit_length() - 1
        bits = leaves[leaf]
        low = bits & -bits
        rank = (leaf << _BITS) + low.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            if bits == low:
                del leaves[leaf]
                top ^= 1 << leaf
            else:
                leaves[leaf] = bits ^ low
        if wanted[i] != rank:
            continue  # a neighbour's merge has outdated it
        gone = after[i]
        end = after[gone]
        after[i] = end
        ids[i] = rank
        wanted[gone] = -1
        if end < n:
            before[end] = i
            wanted[i] = rank = get(piece[i : after[end]], -1)
            if rank >= 0:
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    leaf = rank >> _BITS
                    if leaf in leaves:
                        leaves[leaf] |= bit[rank & _MASK]
                    else:
                        leaves[leaf] = bit[rank & _MASK]
                        top |= 1 << leaf
        else:
            wanted[i] = -1
        left = before[i]
        if left >= 0:
            wanted[left] = rank = get(piece[left:end], -1)
            if rank >= 0:
                if rank in buckets:
                    heappush(buckets[rank], left)
                else:
                    buckets[rank] = [left]
                    leaf = rank >> _BITS
                    if leaf in leaves:
                        leaves[leaf] |= bit[rank & _MASK]
                    else:
                        leaves[leaf] = bit[rank & _MASK]
                        top |= 1 << leaf
    out, i = [], 0
    while i < n:
        end = after[i]
        out.append(ids[i] if end > i + 1 else ranks[piece[i:end]])
        i = end
    return out


def byte_pairs(ranks: dict[bytes, int]) -> list[list[int]]:
    """The rank of each pair of bytes, -1 where it has none."""
    out = [[-1] * 256 for _ in range(256)]
    for token, rank in ranks.items():
        if len(token) == 2:
            out[token[0]][token[1]] = rank
    return out


#: Letters, numbers and white space below U+0180: for texts within that range the standard library's faster
#: regular expressions stand for the pattern's Unicode classes.
_L, _N, _S, _END = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", "\\t-\\r \u0085 ", "ƀ"


class Codec:
    """Encodes to and decodes from the ids of a rank file; keeps a bounded cache of pre-tokens."""

    def __init__(self, path: str, pattern: str, cached: int = CACHED, most: int = CACHED_BYTES) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pairs = byte_pairs(self.ranks)
        self.find = regex.compile(pattern).findall
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]").replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", f"[{_N}]").replace(r"\S", f"[^{_S}]").replace(r"\s", f"[{_S}]")
        self.find_narrow = re.compile(narrow).findall if "\\p" not in narrow else self.find
        self.wide = re.compile(f"[{_END}-\U0010ffff]").search
        own = self

        class Cache(dict):
            """Two generations: a full one becomes the old one, from which what is still in use comes back."""

            old: dict[str, bytes] = {}
            size = 0  # bytes of the new one

            def __missing__(self, piece: str) -> bytes:
                ids = self.old.get(piece)
                if ids is None:
                    found = merge(piece.encode(), own.ranks, own.pairs)
                    ids = pack(f"<{len(found)}i", *found)
                if len(piece) <= CACHED_CHARS:
                    taken = getsizeof(piece) + getsizeof(ids) + ENTRY
                    if len(self) >= cached or self.size + taken > most:
                        self.old = dict(self)
                        self.clear()
                        self.size = 0
                    self[piece] = ids
                    self.size += taken
                return ids

        self.cache = Cache()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        find = self.find if self.wide(text) else self.find_narrow
        return b"".join(map(self.cache.__getitem__, find(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_open: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, cached: int = CACHED) -> Codec:
    """This worker's codec for a rank file; it outlives a task."""
    if (path, pattern, cached) not in _open:
        _open.clear()
        _open[path, pattern, cached] = Codec(path, pattern, cached)
    return _open[path, pattern, cached]


def _lists(raw: list[bytes]) -> pa.Array:
    """array<int> of packed ids."""
    bounds = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """A column in pieces of about ``most`` bytes, one row at least."""
    a, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size > most and i > a:
            yield texts.slice(a, i - a)
            a, size = i, n or 0
    if a < len(texts):
        yield texts.slice(a)


def encode_text(text: Column, path: str, pattern: str) -> Column:
    """array<int>: the ids of the whole text, each match of ``pattern`` merged by itself. Null and empty: no ids."""
    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for column in batches:
            for texts in slices(column):
                yield _lists([own.encode(x) for x in texts.to_pylist()])

    return ids(text)


def decode_ids(ids: Column, path: str, pattern: str) -> Column:
    """binary: the bytes that the ids stand for. Null: no bytes. An id outside the rank file fails the task."""
    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for lists in batches:
            yield pa.array([own.decode(x or []) for x in lists.to_pylist()], pa.binary())

    return raw(ids)


def bpe_roundtrip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", cached: int = CACHED) -> DataFrame:
    """``df`` with the ids of ``text`` and the bytes decoded from these ids.

    Both are made in one pass, by one codec in one worker, in slices of about ``SLICE`` bytes of text; a longer text is
    encoded alone, whole. Null and empty texts have no ids and decode to no bytes. Other columns stay; one named as an
    output is replaced. Rows are encoded one by one, so repeated ones alike. An empty table gives an empty one.
    ``cached`` pre-tokens at most are kept by each worker, and fewer where ``CACHED_BYTES`` are full: memory against
    speed, never a result.
    """

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern, cached)
        for column in batches:
            for texts in slices(column):
                raw = [own.encode(x) for x in texts.to_pylist()]
                back = [own.decode(np.frombuffer(x, "<i4").tolist()) for x in raw]
                yield pa.StructArray.from_arrays([_lists(raw), pa.array(back, pa.binary())], ["ids", "decoded"])

    name = fresh(df, "both")["both"]
    out = df.withColumn(name, both(F.col(quoted(text))))
    return out.withColumn(ids, F.col(name)["ids"]).withColumn(decoded, F.col(name)["decoded"]).drop(name)
