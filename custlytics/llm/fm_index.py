"""A compressed index of a sequence of numbers: backward search and located occurrences.

The sequence's suffixes are sorted, the symbols before them are kept in a wavelet matrix with ranks over
64-bit words, and every ``SAMPLED``-th suffix position is kept to locate occurrences. All queries work on
arrays: many phrases, or many occurrences, take each step together.
"""

from __future__ import annotations

import numpy as np

#: One suffix position in so many is kept.
SAMPLED = 16


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes in sorted order; a suffix that is a prefix of another comes first."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    known = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: max(n - known, 0)] = rank[known:]
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        steps = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank[order] = steps + 1
        if steps[-1] == n - 1:
            return order
        known *= 2


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class FmIndex:
    """Index of ``sequence``, whose symbols are 0 to ``n_symbols`` - 1."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        # A symbol of its own ends the sequence.
        s = np.concatenate((np.asarray(sequence, np.int64) + 1, [0]))
        self.n = len(s)
        order = suffix_order(s)
        kept = order % SAMPLED == 0
        self.kept, self.places = Bits(kept), order[kept]
        row = s[order - 1]
        counts = np.bincount(s, minlength=n_symbols + 1)
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        self.levels = []
        self.depth = max(1, int(n_symbols).bit_length())
        for shift in range(self.depth - 1, -1, -1):
            ones = (row >> shift) & 1 == 1
            self.levels.append((shift, Bits(ones), self.n - int(ones.sum())))
            row = np.concatenate((row[~ones], row[ones]))
        self.base = self._down(np.arange(n_symbols + 1), np.zeros(n_symbols + 1, np.int64))

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbols >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def _before(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The row that suffixes of the first i rows get when the symbol is put before them."""
        return self.starts[symbols] + self._down(symbols, i) - self.base[symbols]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases are rows of an array."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = np.flatnonzero((lengths > step) & (low < high))
            symbols = phrases[live, lengths[live] - 1 - step] + 1
            low[live], high[live] = self._before(symbols, low[live]), self._before(symbols, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows, by steps back to a kept one."""
        out, todo, rows, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            kept = self.kept.at(rows)
            out[todo[kept]] = self.places[self.kept.rank(rows[kept])] + steps
            todo, rows, steps = todo[~kept], rows[~kept], steps + 1
            symbols, i = np.zeros(len(rows), np.int64), rows
            for _, bits, zeros in self.levels:
                one, ones = bits.at(i), bits.rank(i)
                i = np.where(one, zeros + ones, i - ones)
                symbols = symbols * 2 + one
            rows = self.starts[symbols] + i - self.base[symbols]
        return out
