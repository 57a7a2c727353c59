"""An FM-index over a sequence of integers, with all queries vectorised over many patterns."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes of seq in order, by prefix doubling; the last value must be unique and smallest."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank, k = rank.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= n:
            return order


class FMIndex:
    """Backward search and location over a sequence of values 1..sigma-1.

    The Burrows-Wheeler transform is held as a wavelet matrix (one bit vector with
    running ranks for each bit of a value); every `rate`-th text position keeps its
    suffix position, and others walk back to one.
    """

    def __init__(self, seq: np.ndarray, sigma: int, rate: int = 8):
        text = np.concatenate([np.asarray(seq, np.int64), [0]])
        sa = suffix_array(text)
        self.n, self.bits = len(text), max(1, int(sigma - 1).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])  # rows of smaller values
        bwt = text[sa - 1]
        self.ranks, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (bwt >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        marked = sa % rate == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)]).astype(np.int32)
        self.samples = sa[marked]

    def _rank(self, value: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each value in the transform's first `row` places."""
        lo, hi = np.zeros_like(row), row
        for level in range(self.bits):
            one = ((value >> (self.bits - 1 - level)) & 1).astype(bool)
            ranks, zeros = self.ranks[level], self.zeros[level]
            lo, hi = (np.where(one, zeros + ranks[x], x - ranks[x]) for x in (lo, hi))
        return hi - lo

    def _value(self, row: np.ndarray) -> np.ndarray:
        """The transform's value at each row."""
        value = np.zeros_like(row)
        for level in range(self.bits):
            ranks = self.ranks[level]
            one = ranks[row + 1] - ranks[row]
            value = value * 2 + one
            row = np.where(one == 1, self.zeros[level] + ranks[row], row - ranks[row])
        return value

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows [lo, hi) of each pattern; patterns are right-aligned rows of a matrix."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width):
            go = np.flatnonzero((lengths > k) & (hi > lo))
            if not len(go):
                break
            c = patterns[go, width - 1 - k]
            lo[go] = self.before[c] + self._rank(c, lo[go])
            hi[go] = self.before[c] + self._rank(c, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix row."""
        out, back, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(rows):
            known = self.marks[rows + 1] > self.marks[rows]
            out[at[known]] = self.samples[self.marks[rows[known]]] + back
            rows, at = rows[~known], at[~known]
            value = self._value(rows)
            rows = self.before[value] + self._rank(value, rows)
            back += 1
        return out
