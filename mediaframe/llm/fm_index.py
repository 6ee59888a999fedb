"""A compressed FM-index over integer sequences, searched for many patterns at once."""
from __future__ import annotations

import numpy as np

ONE, LOW6 = np.uint64(1), 63


class BitVector:
    """Packed bits with a count per word: rank by one look-up and one population count."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((ONE << (at & LOW6).astype(np.uint64)) - ONE))


class WaveletTree:
    """Ranks of symbols in a sequence, a bit vector for each binary digit (high to low)."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, current = [], sequence
        for digit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = (current >> digit) & 1 == 1
            zeros = int(len(bit) - bit.sum())
            self.levels.append((digit, zeros, BitVector(bit)))
            current = np.concatenate([current[~bit], current[bit]])
        self.begin = np.searchsorted(current, np.arange(symbols)) if self._ordered(current) else self._begins(current, symbols)

    @staticmethod
    def _ordered(current: np.ndarray) -> bool:
        return bool(len(current) < 2 or (current[1:] >= current[:-1]).all())

    @staticmethod
    def _begins(current: np.ndarray, symbols: int) -> np.ndarray:
        found, first = np.unique(current, return_index=True)
        begin = np.zeros(symbols, np.int64)
        begin[found] = first
        return begin

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        place = at
        for digit, zeros, bits in self.levels:
            ones = bits.rank(place)
            place = np.where((symbol >> digit) & 1 == 1, zeros + ones, place - ones)
        return place - self.begin[symbol]


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts in the order of their first `depth` symbols, by doubling."""
    rank, width, n = text.astype(np.int64), 1, len(text)
    while True:
        after = np.zeros(n, np.int64)
        if width < n:
            after[: n - width] = rank[width:] + 1
        order = np.argsort(key := rank * (int(rank.max(initial=0)) + 2) + after, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) if n else 0
        rank, width = new, 2 * width
        if width >= depth or n == 0 or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Counts weighted occurrences of patterns up to `depth` symbols in many sequences.

    `text` joins the sequences, each followed by a 0 (symbols are above 0); `weight` has each
    place's weight.
    """

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        order = sorted_suffixes(text, depth)
        symbols = int(text.max(initial=0)) + 1
        self.tree = WaveletTree(text[order - 1], symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:symbols]
        mass = np.concatenate([[0], np.cumsum(weight[order])])
        self.mass = mass.astype(np.uint32) if mass[-1] < 2**32 else mass
        self.size = len(text)

    def shortest_begin(self, text: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
        """Backward searches of text[low:high], all together: for each the smallest f such that
        text[f:high] occurs with weight `least` or more; high where not even the last symbol does."""
        found = high.copy()
        who = np.arange(len(low))
        lo, hi = np.zeros(len(low), np.int64), np.full(len(low), self.size)
        at = high - 1
        while len(who):
            symbol = text[at]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.less[symbol], 2)
            lo, hi = both[: len(who)], both[len(who) :]
            enough = self.mass[hi] - self.mass[lo] >= least
            found[who[enough]] = at[enough]
            going = enough & (at > low[who])
            who, lo, hi, at = who[going], lo[going], hi[going], at[going] - 1
        return found
