"""An FM-index over runs of symbols: backward search and location of many patterns at once.

The text is a row of runs, each closed by symbol 0; patterns hold no 0. Each
separator sorts as a symbol of its own, by place, so suffixes differ within
their run and the suffix sort ends after a few doublings. A walk back never
crosses a separator, since every run's start is sampled.
"""

import numpy as np

SAMPLE_EVERY = 16
_ONE = np.uint64(1)


class BitRanks:
    """A bit vector with a running count per 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((_ONE << bit) - _ONE))


class WaveletRanks:
    """Ranks of any symbol, one bit vector per binary digit, the highest first."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.levels = []
        rest = symbols
        for shift in range(digits - 1, -1, -1):
            bits = (rest >> shift) & 1
            ranks = BitRanks(bits)
            zeros = len(bits) - int(ranks.before[-1])
            self.levels.append((shift, ranks, zeros))
            rest = np.concatenate([rest[bits == 0], rest[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        low, high = np.zeros_like(i), i
        for shift, ranks, zeros in self.levels:
            one = ((symbol >> shift) & 1) == 1
            low_ones, high_ones = ranks.ones(low), ranks.ones(high)
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling; each 0 sorts before all else, in order of place."""
    n = len(symbols)
    zero = symbols == 0
    zeros = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + zeros)
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], in_order[1:] != in_order[:-1]]))
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, size: int):
        """``symbols`` ends with a 0; all are below ``size``."""
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]
        self.ranks = WaveletRanks(self.bwt, max(1, int(size - 1).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        starts_run = np.concatenate([[True], symbols[:-1] == 0])
        sampled = ((order % SAMPLE_EVERY) == 0) | starts_run[order]
        self.marks = BitRanks(sampled)
        self.sampled = sampled
        self.places = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes that begin with each pattern (left-aligned rows of ``patterns``)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        for step in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > step) & (high > low))
            if not len(live):
                continue
            symbol = patterns[live, lengths[live] - 1 - step]
            base = self.below[symbol]
            low[live] = base + self.ranks.rank(symbol, low[live])
            high[live] = base + self.ranks.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a sampled one."""
        rows = rows.copy()
        walked = np.zeros(len(rows), np.int64)
        while True:
            go = np.flatnonzero(~self.sampled[rows])
            if not len(go):
                return self.places[self.marks.ones(rows)] + walked
            symbol = self.bwt[rows[go]]
            rows[go] = self.below[symbol] + self.ranks.rank(symbol, rows[go])
            walked[go] += 1
