"""Arrow text columns as flat numpy arrays of words and n-grams."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}

IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are no part of words of ASCII letters and digits and all characters beyond ASCII.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, _CHUNK + 1), np.uint64(base))
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


@dataclass
class Words:
    """Words of consecutive texts: byte places in `data`, 64-bit hashes, and the first word of each text."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more than texts

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.count())


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and the first word of each text (one more than texts)."""
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def split_words(column: pa.Array, lower: bool = False, separators: np.ndarray = SPACES) -> Words:
    """All words of a string column; null counts as empty. Works on about a megabyte at a time."""
    raw, offsets = flat_text(column)
    data = LOWER[raw] if lower else raw
    start, end, first = word_bounds(data, offsets, separators)
    return Words(data, start, end, _hashes(data, start, end), first)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte slices in order, from prefix sums over blocks of whole slices."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        at = start[lo]
        hi = max(lo + 1, int(np.searchsorted(end, at + _CHUNK, "right")))
        n = int(end[hi - 1] - at)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[at : at + n].astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
        s, e = start[lo:hi] - at, end[lo:hi] - at
        out[lo:hi] = (sums[e] - sums[s]) * _power(_INVERSE, n)[s]
        lo = hi
    return mix(out)


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its beginning and that of its last word."""
    return mix(left * np.uint64(_BASE) + (right ^ _MIX2))


def texts_in_blocks(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text stands alone."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))])
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi
