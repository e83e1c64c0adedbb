"""Shared helpers: text columns, slices and vectorised word hashing.

The hashing works on slices of a few hundred kilobytes of UTF-8, so a task's
memory is bounded by one Arrow batch plus one slice, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lodestream.operators.ordering import numbered  # noqa: F401
from lodestream.sources.scratch import materialise  # noqa: F401
from lodestream.sources.tables import table  # noqa: F401

SLICE_BYTES = 1 << 18


def null_to_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string column holding about `size` bytes each (one row at least)."""
    n = len(texts)
    if not n:
        return
    lengths = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    ends = np.cumsum(lengths)
    begin = 0
    while begin < n:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield begin, end
        begin = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes of a column slice, and its row offsets (nulls are empty)."""
    rows = [x.encode() if x else b"" for x in texts.to_pylist()]
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return np.frombuffer(b"".join(rows), np.uint8), offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class WordHasher:
    """Hashes of the words of many texts at once.

    A word's hash is a polynomial in an odd base modulo 2^64 over random byte
    values, taken from one prefix sum, so no Python loop runs over words.
    Bytes that `table` maps to 0 separate words; others are replaced by it
    first (that is how letters are lower-cased).
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, table: np.ndarray):
        values = stream(256, 77)
        self.values = np.where(table == 0, np.uint64(0), values[table])
        self.separates = table == 0
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, SLICE_BYTES * 2)
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, self.BASE, np.uint64))])
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, pow(self.BASE, -1, 1 << 64), np.uint64))])

    def words(self, data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()):
        """(hashes, first word of each row and the end, starts, ends, hashes of each prefix length).

        Words shorter than a prefix length are their own prefix.
        """
        n = len(data)
        self._grow(n + 1)
        gap = np.ones(n + 1, bool)
        gap[:n] = self.separates[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        word = ~gap[:n]
        before = np.ones(n, bool)
        before[1:] = gap[: max(0, n - 1)]
        starts = np.flatnonzero(word & (before | first[:n]))
        ends = np.flatnonzero(word & (gap[1:] | first[1:])) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])

        def of(cut: np.ndarray, tag: int) -> np.ndarray:
            return mix((sums[cut] - sums[starts]) * self.inverse[starts] + (cut - starts).astype(np.uint64) + np.uint64(tag << 32))

        return of(ends, 0), np.searchsorted(starts, offsets), starts, ends, [of(np.minimum(ends, starts + k), k) for k in prefixes]


def ascii_lower_table(separators: bytes) -> np.ndarray:
    """Byte map: A-Z to a-z, separators to 0, NUL to an unused byte."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[0] = 0xFF
    t[list(separators)] = 0
    return t


SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def shingle_sets(hasher: WordHasher, texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles.

    With fewer words than n the whole sequence is one shingle; without words
    the set is empty.
    """
    factors = np.array([pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(n)], np.uint64)
    for a, b in slices(texts):
        hashes, rows = hasher.words(*utf8(texts[a:b]))[:2]
        total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for j in range(n):
            total += hashes[j : j + len(total)] * factors[j]
        total = mix(total)
        for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if hi - lo >= n:
                yield np.unique(total[lo : hi - n + 1])
            elif hi > lo:
                few = hashes[lo:hi] * factors[: hi - lo]
                yield mix(few.sum(dtype=np.uint64)[None] + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)
