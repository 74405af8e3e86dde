"""FM-index over word identifiers: backward search through wavelet-matrix ranks, and locating by sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Separators (0) are distinct from each other, in order of their position."""
    n = len(symbols)
    separators = symbols == 0
    rank = symbols.astype(np.int64) + int(separators.sum())
    rank[separators] = np.arange(int(separators.sum()))
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.append(0, np.cumsum(ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.zeros(len(now) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.start = self.down(np.arange(size), np.zeros(size, np.int64))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - i)) & 1
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of the symbol before each place."""
        return self.down(symbol, at) - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return symbol, at - self.start[symbol]


class FMIndex:
    """Of symbols 0 to size - 1, where 0 separates runs; the first symbol must be a separator."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = 16):
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.tree = WaveletMatrix(before, size)
        # Every sample-th position is kept, and those after a separator, so that no walk crosses one.
        sampled = (order % sample == 0) | (before == 0) | (symbols[order] == 0)
        self.sampled = sampled
        self.sample_rank = np.append(0, np.cumsum(sampled))
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row bounds of the suffixes that begin with each pattern (a row of symbols)."""
        n, length = patterns.shape
        low, high = np.zeros(n, np.int64), np.full(n, self.first[-1], np.int64)
        live = np.arange(n)
        for k in range(length - 1, -1, -1):
            symbol = patterns[live, k]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        high = np.maximum(high, low)
        dead = np.ones(n, bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: walk back to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.sampled[here]
            out[open_[done]] = self.positions[self.sample_rank[here[done]]] + steps[open_[done]]
            open_ = open_[~done]
            symbol, rank = self.tree.access(rows[open_])
            rows[open_] = self.first[symbol] + rank
            steps[open_] += 1
        return out
