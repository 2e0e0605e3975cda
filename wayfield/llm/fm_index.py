"""A compressed full-text index over integer symbols: wavelet matrix, ranks, backward search; all in numpy.

The suffix order is used to build the last column and dropped: all patterns are streamed in text order, so
the first one that meets an interval is the interval's first place, and no place need be located.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a suffix that ends first is smaller."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        tail = np.zeros(n, np.int64)
        if step < n:
            tail[:-step] = rank[step:] + 1
        key = rank * (n + 1) + tail
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            break
        step *= 2
    return order


class Bits:
    """A bit vector with rank: 64-bit blocks and the count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.blocks), np.int32)
        np.cumsum(np.bitwise_count(self.blocks[:-1]), out=self.before[1:])
        self.ones = int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & low)


class FMIndex:
    """Passages over symbols >= 1, each closed by the separator 0; counts and finds by backward search."""

    def __init__(self, text: np.ndarray):
        """``text``: symbols with a 0 after each passage; separators sort before all symbols and in text order."""
        n, gap = len(text), text == 0
        n_gaps = int(gap.sum())
        own = np.where(gap, np.cumsum(gap) - 1, text.astype(np.int64) + n_gaps)
        last = text[suffix_order(own) - 1]  # the suffix order itself isn't kept
        self.sigma = int(text.max(initial=0)) + 1
        self.begin = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.sigma), out=self.begin[1:])
        self.n = n
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bits = ((last >> shift) & 1).astype(np.uint8)
            vector = Bits(bits)
            zeros = n - vector.ones
            self.levels.append((shift, vector, zeros))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        self.base = self._descend(np.arange(self.sigma), np.zeros(self.sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, vector, zeros in self.levels:
            ones = vector.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern, from those of the patterns."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.begin[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift

    def search(self, text: np.ndarray, ends: np.ndarray, length: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For patterns text[end-length:end]: matched length (up to ``length``), low and high of its interval.

        A search stops once fewer than ``least`` places are left; its matched
        length is then under ``length``.
        """
        matched = np.zeros(len(ends), np.int64)
        low_all, high_all = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        alive = np.arange(len(ends))
        for k in range(1, length + 1):
            symbol = text[ends[alive] - k]
            low, high = self.extend(symbol, low_all[alive], high_all[alive])
            good = high - low >= least
            alive, low, high = alive[good], low[good], high[good]
            low_all[alive], high_all[alive], matched[alive] = low, high, k
            if not len(alive):
                break
        return matched, low_all, high_all


def earlier(low: np.ndarray) -> np.ndarray:
    """Whether an equal pattern comes before each one, for patterns of one length in text order: its interval was met before."""
    again = np.ones(len(low), bool)
    again[np.unique(low, return_index=True)[1]] = False
    return again
