"""A run-length grammar of many word sequences by recompression, and extension queries on it.

Rounds alternate two steps. Block compression names each maximal block of one symbol by symbol and count; pair compression
deals symbols to two sides by a coin and names each left symbol followed by a right one. Equal words are cut alike but
for their edges, so two places are compared by climbing: at each level at most one step is taken until both stand at
the edge of a parent, and after the first difference at most one step a level on the way down. A query takes a number of
steps in proportion to the levels, whatever its answer; all queries go through the levels together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Level:
    """Symbols, the parent of each in the next level, and each parent's first child; block tells how parents were made."""

    symbol: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    block: bool

    def child(self, up: np.ndarray, step: int) -> np.ndarray:
        """The child of parents `up` that a walk in the direction of step meets first."""
        return self.first[up] if step > 0 else self.first[up + 1] - 1

    def left_in_block(self, at: np.ndarray, step: int) -> np.ndarray:
        up = self.parent[at]
        return self.first[up + 1] - at if step > 0 else at - self.first[up] + 1


def _coin(symbol: np.ndarray, turn: int) -> np.ndarray:
    x = (symbol.astype(np.uint64) + np.uint64(turn * 0x51ED2701)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(63)).astype(bool)


class Grammar:
    """Of words (numbers from 0) in sequences of the given sizes, one after another; `at` is where each starts in the levels' own count."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        # a mark of its own before each sequence, and one at the end: marks join nothing and equal nothing
        self.at = ends - sizes + np.arange(1, len(sizes) + 1)
        now = np.insert(words.astype(np.int64), np.r_[ends - sizes, len(words)], -1 - np.arange(len(sizes) + 1))
        fresh = int(words.max(initial=-1)) + 1
        alone = 2 * len(sizes) + 1
        self.levels: list[Level] = []
        turn = 0
        while len(now) > alone:
            start = np.flatnonzero(np.r_[True, now[1:] != now[:-1]])
            count = np.diff(np.r_[start, len(now)])
            if len(start) < len(now):
                up = now[start].copy()
                several = np.flatnonzero(count > 1)
                names, name = np.unique(up[several] * (len(now) + 1) + count[several], return_inverse=True)
                up[several] = fresh + name
                fresh += len(names)
                self._push(now, start, True)
                now = up
            right = _coin(now, turn) & (now >= 0)
            left = ~right & (now >= 0)
            pair = np.flatnonzero(left[:-1] & right[1:])
            if len(pair):
                names, name = np.unique(now[pair] * fresh + now[pair + 1], return_inverse=True)
                stay = np.ones(len(now), bool)
                stay[pair + 1] = False
                up = now.copy()
                up[pair] = fresh + name
                fresh += len(names)
                self._push(now, np.flatnonzero(stay), False)
                now = up[stay]
            turn += 1
        self.top = now

    def _push(self, symbol: np.ndarray, start: np.ndarray, block: bool) -> None:
        parent = np.zeros(len(symbol), np.int32)
        parent[start] = 1
        self.levels.append(Level(symbol.astype(np.int32), np.cumsum(parent, dtype=np.int32) - 1, np.r_[start, len(symbol)].astype(np.int32), block))

    def extend(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many words from places i and j on are equal, forward (step 1) or backward (-1), the places included. i and j differ."""
        a, b, live = i.astype(np.int64).copy(), j.astype(np.int64).copy(), np.arange(len(i))
        stuck: list[np.ndarray] = []
        for level in self.levels:
            x, y = a[live], b[live]
            edge = lambda p, q: (level.child(level.parent[p], step) == p) & (level.child(level.parent[q], step) == q)  # noqa: E731, B023
            inside = np.flatnonzero(~edge(x, y))
            same = inside[level.symbol[x[inside]] == level.symbol[y[inside]]]
            n = step * (np.minimum(level.left_in_block(x[same], step), level.left_in_block(y[same], step)) if level.block else 1)
            x[same] += n
            y[same] += n
            a[live], b[live] = x, y
            up = edge(x, y)
            stuck.append(live[~up])
            live = live[up]
            a[live], b[live] = level.parent[a[live]], level.parent[b[live]]
        same = live
        while len(same := same[self.top[a[same]] == self.top[b[same]]]):
            a[same] += step
            b[same] += step
        for level, waiting in zip(reversed(self.levels), reversed(stuck)):
            x, y = level.child(a[live], step).astype(np.int64), level.child(b[live], step).astype(np.int64)
            same = np.flatnonzero(level.symbol[x] == level.symbol[y])
            n = step * (np.minimum(level.left_in_block(x[same], step), level.left_in_block(y[same], step)) if level.block else 1)
            x[same] += n
            y[same] += n
            a[live], b[live] = x, y
            live = np.r_[live, waiting]
        return (a - i) * step
