"""Nearest sources along the rows of a grid, in numpy; for use inside a task on some rows."""

from __future__ import annotations

import numpy as np

#: The squared distance of a column without any source.
FAR = 1 << 60


def nearest_columns(gap2: np.ndarray, source: np.ndarray) -> np.ndarray:
    """For each cell (row, col) the column c' with the smallest gap2[row, c'] + (col - c')**2, ties to the smaller (source row, c').

    gap2 holds squared distances within each column. Two columns change places once along a row, so the best columns of a
    row ascend: the middle column is settled first, then the middles of both halves between what is known, all rows together.
    """
    n, w = gap2.shape
    best = np.zeros((n, w), np.int64)
    step = 1 << (w.bit_length() - 1)
    done = step * 2
    while step:
        cols = np.arange(step - 1, w, done)
        low = np.where(cols - step >= 0, best[:, np.maximum(cols - step, 0)], 0)
        high = np.where(cols + step < w, best[:, np.minimum(cols + step, w - 1)], w - 1)
        count = (high - low + 1).ravel()
        first = np.cumsum(count) - count
        cand = np.arange(count.sum()) - np.repeat(first - low.ravel(), count)
        row = np.repeat(np.repeat(np.arange(n), len(cols)), count)
        cost = np.minimum(gap2[row, cand] + (np.repeat(np.tile(cols, n), count) - cand) ** 2, FAR)
        least = np.repeat(np.minimum.reduceat(cost, first), count)
        rank = np.where(cost == least, source[row, cand] * w + cand, np.iinfo(np.int64).max)
        best[:, cols] = (np.minimum.reduceat(rank, first) % w).reshape(n, len(cols))
        done, step = step, step // 2
    return best
