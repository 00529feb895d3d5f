"""An FM-index over integer sequences: suffix array, wavelet matrix, backward search, sampled positions.

Symbols are 1..sigma; 0 separates segments. Separators count as distinct
symbols below all others, so common prefixes end at a segment's end and the
sorting rounds grow with the logarithm of the longest repeated segment only.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    gaps = text == 0
    first = text.astype(np.int64) + int(gaps.sum())
    first[gaps] = np.arange(int(gaps.sum()))
    sa = np.argsort(first, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.r_[True, first[sa][1:] != first[sa][:-1]]
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    h, open_ = 1, _ties(start)
    while len(open_):
        own = sa[open_]
        key = rank[own] * (n + 1) + rank[np.minimum(own + h, n)] + 1
        order = np.argsort(key, kind="stable")
        sa[open_], key = own[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        rank[sa[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2
        open_ = open_[_ties(new)]
    return sa


def _ties(start: np.ndarray) -> np.ndarray:
    """Positions of members of groups of two or more, ``start`` marking a group's first."""
    alone = start & np.r_[start[1:], True]
    return np.flatnonzero(~alone)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            self.ones.append(np.r_[np.int32(0), np.cumsum(bit, dtype=np.int32)])
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``."""
        lo, hi = np.zeros_like(at), at
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``at`` and how often it stands before."""
        symbol, lo, hi = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[lo], ones[hi]
            one = ones[hi + 1] > b
            symbol = symbol * 2 + one
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return symbol, hi - lo


class FMIndex:
    """``text``: segments of symbols, each followed by a 0; the first symbol is a 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        sa = suffix_array(text)
        bwt = text[sa - 1]                     # before the first symbol stands the last, a 0
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), max(1, int(sigma).bit_length()))
        self.smaller = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma + 1))].astype(np.int64)
        sampled = (sa % SAMPLE == 0) | (bwt == 0)   # and the first symbol of every segment
        self.marks = np.r_[np.int64(0), np.cumsum(sampled)]
        self.samples = sa[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases of one length (rows), by backward search."""
        lo = self.smaller[phrases[:, -1]]
        hi = self.smaller[phrases[:, -1] + 1]
        alive = np.flatnonzero(lo < hi)
        for j in reversed(range(phrases.shape[1] - 1)):
            c = phrases[alive, j]
            base = self.smaller[c]
            lo[alive], hi[alive] = base + self.wavelet.rank(c, lo[alive]), base + self.wavelet.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the next sampled one."""
        out, todo, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.marks[at + 1] > self.marks[at]
            out[todo[hit]] = self.samples[self.marks[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            symbol, before = self.wavelet.access_rank(at)
            at, steps = self.smaller[symbol] + before, steps + 1
        return out
