"""Suffix arrays, wavelet matrix and FM-index over integer symbols, in numpy; every query is answered for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` by prefix doubling; suffixes whose place is settled are left out of later rounds."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    order = np.argsort(text, kind="stable").astype(np.int32)
    rank = np.empty(n, dtype=np.int32)

    def heads(keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        out[1:] = keys[1:] != keys[:-1]
        return out

    new = heads(text[order])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    open_ = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)  # places whose suffix shares its rank
    h = 1
    while len(open_):
        at = order[open_]
        key = rank[at].astype(np.int64) * (n + 1)
        key += np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        del by
        order[open_] = at
        new = heads(key)
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols below 2 ** bits: one bit vector with running counts for each bit, zeros sorted before ones from level to level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = symbols >> bit & 1
            counts = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((bit, counts, len(symbols) - int(counts[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        self.start = self.place(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, counts, zeros in self.levels:
            one = counts[at]
            at = np.where(symbol >> bit & 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        return self.place(symbol, at) - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``at`` and how often it occurs before."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for bit, counts, zeros in self.levels:
            one = counts[at]
            is_one = counts[at + 1] > one
            symbol |= is_one.astype(np.int64) << bit
            at = np.where(is_one, zeros + one, at - one)
        return symbol, at - self.start[symbol]


class FMIndex:
    """Self-index of a text of symbols 0..top. Every ``sample``-th text position is kept for locating.

    Symbols are stored one higher, for a 0 that ends the text and occurs nowhere else.
    """

    def __init__(self, text: np.ndarray, top: int, sample: int = 8):
        text = np.append(text.astype(np.int64) + 1, 0)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n, self.sample = len(text), sample
        self.wavelet = WaveletMatrix(bwt, max(1, int(top + 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 2))])
        order = order.astype(np.int64)
        marked = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.positions = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of patterns of one length (a row each), by backward search; low = high where there is none."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, j] + 1
            low[alive] = self.first[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        high = np.maximum(low, high)
        dead = np.ones(len(patterns), dtype=bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the text until a sampled position."""
        out, rows, steps = np.zeros(len(rows), dtype=np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            found = self.marks[rows + 1] > self.marks[rows]
            out[todo[found]] = self.positions[self.marks[rows[found]]] + steps
            todo, rows = todo[~found], rows[~found]
            if len(todo):
                symbol, before = self.wavelet.access(rows)
                rows = self.first[symbol] + before
            steps += 1
        return out
