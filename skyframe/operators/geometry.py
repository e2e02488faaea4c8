"""Plane geometry of one point set in numpy."""

from __future__ import annotations

import numpy as np


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each of n > k points, nearest first, ties by number."""
    d2 = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    np.fill_diagonal(d2, np.inf)
    limit = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(d2 <= limit)  # all that tie with the k-th
    order = np.lexsort((col, d2[row, col], row))
    row, col = row[order], col[order]
    return col[np.searchsorted(row, np.arange(len(x)))[:, None] + np.arange(k)]


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of the corners of the convex hull; of points on a line the two ends."""
    order = np.lexsort((y, x))
    if len(order) < 3:
        return order
    new = np.ones(len(order), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    order = order[new]

    def half(points):
        kept: list[int] = []
        for i in points:
            while len(kept) > 1 and (x[kept[-1]] - x[kept[-2]]) * (y[i] - y[kept[-2]]) <= (y[kept[-1]] - y[kept[-2]]) * (x[i] - x[kept[-2]]):
                kept.pop()
            kept.append(i)
        return kept

    return np.unique(np.array(half(order.tolist()) + half(order[::-1].tolist())))


def diameter(x: np.ndarray, y: np.ndarray) -> float:
    """Largest distance between two points."""
    at = hull(x, y)
    return max((float(np.sqrt(((x[at] - x[i]) ** 2 + (y[at] - y[i]) ** 2).max())) for i in at), default=0.0)


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels (y, x) of the mask in row order and the number of the 8-connected component of each.

    Runs of pixels in a row are joined with those they touch in the row above by union-find.
    """
    ny, nx = mask.shape
    padded = np.zeros((ny, nx + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    parent = np.arange(len(row))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(ny + 1))
    for y in range(1, ny):
        a, b = first[y - 1], first[y]
        i = a
        for j in range(b, first[y + 1]):
            while i < b and end[i] < start[j]:
                i += 1
            k = i
            while k < b and start[k] <= end[j]:
                u, v = find(k), find(j)
                if u != v:
                    parent[max(u, v)] = min(u, v)
                k += 1
    roots = np.array([find(i) for i in range(len(row))], np.int64)
    length = end - start
    ys = np.repeat(row, length)
    xs = np.arange(int(length.sum())) + np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) if len(row) else np.empty(0, np.int64)
    _, label = np.unique(np.repeat(roots, length), return_inverse=True)
    return ys, xs, label
