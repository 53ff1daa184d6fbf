"""An FM-index over a string of integers: suffix order, wavelet ranks, backward search.

Symbol 0 separates runs; a search never crosses it. All methods work on arrays of patterns
or rows at once. Nothing here knows Spark.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling. Each separator is a symbol of
    its own, so comparisons end there."""
    n, gaps = len(text), text == 0
    rank = np.where(gaps, np.cumsum(gaps), text.astype(np.int64) + int(gaps.sum()))
    k = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (int(max(rank.max(), ahead.max())) + 1) + ahead
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        k *= 2
        if rank.max() == n or k >= n:
            return order


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = 16):
        """text: symbols >= 0, ends with 0. Suffixes at every sample-th place and at the
        first of each run keep their place."""
        order = suffix_order(text)
        before = text[order - 1]
        self.before = before
        self.sigma = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.levels = max(1, (self.sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        rest = before
        for level in range(self.levels - 1, -1, -1):
            bit = (rest >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(bit) - int(bit.sum()))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        kept = (order % sample == 0) | (before == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]
        self.n = len(text)

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol precedes the suffixes before each row."""
        start, end = np.zeros(len(row), np.int64), row.astype(np.int64)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][start], self.ones[k][end]
            start = np.where(one, self.zeros[k] + a, start - a)
            end = np.where(one, self.zeros[k] + b, end - b)
        return end - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each row of patterns."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, k]
            known = symbol < self.sigma
            symbol = np.where(known, symbol, 0)
            low = np.where(known, self.first[symbol] + self.rank(symbol, low), 0)
            high = np.where(known, self.first[symbol] + self.rank(symbol, high), 0)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes of the rows, by steps back to kept places."""
        out, at, steps, open_ = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(open_):
            here = at[open_]
            done = self.kept[here + 1] > self.kept[here]
            out[open_[done]] = self.places[self.kept[here[done]]] + steps
            open_, here = open_[~done], here[~done]
            symbol = self.before[here]
            at[open_] = self.first[symbol] + self.rank(symbol, here)
            steps += 1
        return out
