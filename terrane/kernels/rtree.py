"""A static R-tree over points, packed by sort-tile-recursive order and probed for many boxes at once with numpy."""

from __future__ import annotations

import numpy as np

FANOUT = 16


class PointTree:
    """Bulk-loaded tree; ``order`` maps leaf slots to the caller's row numbers."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fanout: int = FANOUT):
        self.fanout, n = fanout, len(x)
        leaves = max(1, -(-n // fanout))
        slices = max(1, int(np.ceil(np.sqrt(leaves))))
        by_x = np.argsort(x, kind="stable")
        strip = np.arange(n) // (slices * fanout)
        inner = np.lexsort((y[by_x], strip))
        self.order = by_x[inner]
        self.x, self.y = x[self.order], y[self.order]
        self.levels: list[tuple[np.ndarray, ...]] = []
        x0 = x1 = self.x
        y0 = y1 = self.y
        while True:
            cuts = np.arange(0, len(x0), fanout)
            x0, y0 = np.minimum.reduceat(x0, cuts), np.minimum.reduceat(y0, cuts)
            x1, y1 = np.maximum.reduceat(x1, cuts), np.maximum.reduceat(y1, cuts)
            self.levels.append((x0, y0, x1, y1))
            if len(x0) <= 1:
                break

    def probe(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (box number, caller's row number) of the points inside each closed box."""
        query = np.arange(len(x0))
        node = np.zeros(len(x0), dtype=np.int64)
        step = np.arange(self.fanout)
        for depth in range(len(self.levels) - 1, -1, -1):
            a0, b0, a1, b1 = self.levels[depth]
            hit = (a0[node] <= x1[query]) & (a1[node] >= x0[query]) & (b0[node] <= y1[query]) & (b1[node] >= y0[query])
            query, node = query[hit], node[hit]
            below = len(self.x) if depth == 0 else len(self.levels[depth - 1][0])
            child = (node[:, None] * self.fanout + step).ravel()
            query = np.repeat(query, self.fanout)
            real = child < below
            query, node = query[real], child[real]
        inside = (self.x[node] >= x0[query]) & (self.x[node] <= x1[query]) & (self.y[node] >= y0[query]) & (self.y[node] <= y1[query])
        return query[inside], self.order[node[inside]]
