"""A run-length grammar of a sequence by recompression, and common extensions of its positions.

Two steps alternate until one symbol is left. Block compression replaces each maximal block of one symbol by a
symbol for (symbol, length). Pair compression divides the alphabet in two halves by a hash and replaces each
symbol of the left half and the one of the right half that follows it by a symbol for the pair. Equal symbols
of a level stand for equal stretches, and both steps look at neighbours only: two equal stretches are
replaced alike but for their ends.

A common extension climbs from both positions while both begin a symbol of the next level, first going over what
is left of a block or pair where they do not; the first difference is then followed down to the sequence.
Each level takes a constant number of steps, all queries at once.
"""

from __future__ import annotations

import numpy as np

from custlytics.llm.common import mixed


class Grammar:
    """``sequence`` must begin and end with a number that stands nowhere else in it."""

    def __init__(self, sequence: np.ndarray):
        symbols = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
        self.symbols, self.firsts, self.parents, self.blocks = [symbols], [], [], []
        fresh, seed, block = int(symbols.max()) + 1, 1, True
        while len(symbols) > 1:
            if block:
                groups, made = _block_step(symbols, fresh)
            else:
                groups, made = _pair_step(symbols, fresh, seed)
                seed += 1
            if len(groups) < len(symbols):
                self._add(groups, made, len(symbols), block)
                symbols = made
                fresh = max(fresh, int(made.max()) + 1)
            block = not block

    def _add(self, groups: np.ndarray, made: np.ndarray, n: int, block: bool) -> None:
        starts = np.zeros(n, np.int64)
        starts[groups] = 1
        self.parents.append(np.cumsum(starts) - 1)
        self.firsts.append(np.append(groups, n))
        self.symbols.append(made)
        self.blocks.append(block)

    def extension(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """For positions i and j (never the same), how many symbols from there on are equal (``step`` 1), or
        how many that end there (``step`` -1)."""
        x, y = i.astype(np.int64), j.astype(np.int64)
        level = np.zeros(len(x), np.int64)
        climbing = np.arange(len(x))
        for k, parents in enumerate(self.parents):
            if not len(climbing):
                break
            a, b = x[climbing], y[climbing]
            left_a, left_b = self._left(k, a, step), self._left(k, b, step)
            whole_a, whole_b = self._left(k, a, -step) == 1, self._left(k, b, -step) == 1
            same = self.symbols[k][a] == self.symbols[k][b]
            begins = whole_a & whole_b
            # Over the rest of a block or pair, where one of the two does not begin a symbol above.
            over = np.where(~begins & same, np.minimum(left_a, left_b), 0)
            a, b = a + step * over, b + step * over
            x[climbing], y[climbing] = a, b
            level[climbing] = k
            up = begins | (same & (left_a == left_b))
            climbing = climbing[up]
            x[climbing], y[climbing] = parents[a[up]], parents[b[up]]
            level[climbing] = k + 1
        order = np.argsort(-level, kind="stable")
        sorted_levels = -level[order]
        for k in range(int(level.max(initial=0)) - 1, -1, -1):
            down = order[: np.searchsorted(sorted_levels, -k, "left")]
            a, b = self._child(k, x[down], step), self._child(k, y[down], step)
            same = self.symbols[k][a] == self.symbols[k][b]
            over = np.minimum(self._left(k, a, step), self._left(k, b, step)) if self.blocks[k] else 1
            over = np.where(same, over, 0)
            x[down], y[down] = a + step * over, b + step * over
        return (x - i) * step

    def _left(self, k: int, at: np.ndarray, step: int) -> np.ndarray:
        """Symbols of level k from here to the end (or the begin) of the symbol above, this one included."""
        above = self.parents[k][at]
        return self.firsts[k][above + 1] - at if step > 0 else at - self.firsts[k][above] + 1

    def _child(self, k: int, above: np.ndarray, step: int) -> np.ndarray:
        return self.firsts[k][above] if step > 0 else self.firsts[k][above + 1] - 1


def _numbered(first: np.ndarray, second: np.ndarray, fresh: int) -> np.ndarray:
    """A new symbol for each distinct pair of numbers."""
    keys = first * (int(second.max(initial=0)) + 1) + second
    return np.unique(keys, return_inverse=True)[1] + fresh


def _block_step(symbols: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    groups = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    sizes = np.diff(groups, append=len(symbols))
    made = symbols[groups]
    several = sizes > 1
    made[several] = _numbered(made[several], sizes[several], fresh)
    return groups, made


def _pair_step(symbols: np.ndarray, fresh: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    right = (mixed(symbols.astype(np.uint64) + np.uint64(seed << 40)) & np.uint64(1)).astype(bool)
    one, other = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
    joined = one if one.sum() >= other.sum() else other
    groups = np.flatnonzero(np.concatenate(([True], ~joined)))
    made = symbols[groups]
    pairs = np.flatnonzero(joined)
    made[np.searchsorted(groups, pairs)] = _numbered(symbols[pairs], symbols[pairs + 1], fresh)
    return groups, made
