"""A quadtree over lon/lat built on the driver from a bounded sample; its leaves are the partitions of spatial joins."""

from __future__ import annotations

import numpy as np

WORLD = (-180.0, -90.0, 180.0, 90.0)


class QuadTree:
    """Nodes in arrays: box, first child (four in a row, or -1), leaf number (or -1).

    A leaf whose rows the sample can no longer tell apart (``weight`` rows stand behind each sampled one) is divided further into a
    regular grid of 2**level by 2**level cells. A cell is named by the leaf and its number in the grid.
    """

    def __init__(self, lon: np.ndarray, lat: np.ndarray, leaf_rows: float, max_depth: int = 20, weight: float = 1.0):
        cell_rows, leaf_rows = leaf_rows, max(1.0, leaf_rows / weight)
        boxes, child, leaf, counts, depths, leaf_boxes = [WORLD], [-1], [-1], [], [], []
        todo = [(0, np.arange(len(lon)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            if len(rows) <= leaf_rows or depth == max_depth:
                leaf[node] = len(counts)
                counts.append(len(rows))
                depths.append(depth)
                leaf_boxes.append(boxes[node])
                continue
            x0, y0, x1, y1 = boxes[node]
            xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
            child[node] = len(boxes)
            east, north = lon[rows] >= xm, lat[rows] >= ym
            for k, box in enumerate(((x0, y0, xm, ym), (xm, y0, x1, ym), (x0, ym, xm, y1), (xm, ym, x1, y1))):
                todo.append((len(boxes), rows[(east == bool(k & 1)) & (north == bool(k & 2))], depth + 1))
                boxes.append(box)
                child.append(-1)
                leaf.append(-1)
        self.boxes, self.child, self.leaf = np.array(boxes), np.array(child), np.array(leaf)
        self.counts = np.array(counts)
        self.leaf_boxes = np.array(leaf_boxes)
        rows = np.where(self.counts > 0, self.counts, 0.5 if weight > 1 else 0) * weight
        wanted = np.ceil(np.log(np.maximum(rows / cell_rows, 1)) / np.log(4)).astype(int)
        self.levels = np.clip(wanted, 0, max_depth - np.array(depths))
        self.cell_rows = rows / 4.0**self.levels  # expected in each cell

    @property
    def leaves(self) -> int:
        return len(self.counts)

    def home(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The one cell (leaf, number) that owns each point: cells are closed below and open above."""
        node = np.zeros(len(lon), dtype=np.int64)
        open_ = np.flatnonzero(self.child[node] >= 0)
        while len(open_):
            at = node[open_]
            box = self.boxes[at]
            east = lon[open_] >= (box[:, 0] + box[:, 2]) / 2
            north = lat[open_] >= (box[:, 1] + box[:, 3]) / 2
            node[open_] = self.child[at] + east + 2 * north
            open_ = open_[self.child[node[open_]] >= 0]
        leaf = self.leaf[node]
        column, row = self._place(leaf, lon, 0), self._place(leaf, lat, 1)
        return leaf, column + (row << self.levels[leaf])

    def _place(self, leaf: np.ndarray, v: np.ndarray, axis: int) -> np.ndarray:
        """Column or row of a coordinate in its leaf's grid; the same arithmetic serves points and boxes, so they agree on borders."""
        box, side = self.leaf_boxes[leaf], np.int64(1) << self.levels[leaf]
        low, high = box[:, axis], box[:, axis + 2]
        return np.clip(np.floor((v - low) / (high - low) * side).astype(np.int64), 0, side - 1)

    def touched(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(box number, leaf, number) of all cells that a closed box meets."""
        query, node = np.arange(len(x0)), np.zeros(len(x0), dtype=np.int64)
        found_q, found_l = [], []
        while len(query):
            box = self.boxes[node]
            hit = (box[:, 0] <= x1[query]) & (box[:, 2] >= x0[query]) & (box[:, 1] <= y1[query]) & (box[:, 3] >= y0[query])
            query, node = query[hit], node[hit]
            at_leaf = self.child[node] < 0
            found_q.append(query[at_leaf])
            found_l.append(self.leaf[node[at_leaf]])
            query, node = query[~at_leaf], node[~at_leaf]
            node = (self.child[node][:, None] + np.arange(4)).ravel()
            query = np.repeat(query, 4)
        query, leaf = np.concatenate(found_q), np.concatenate(found_l)
        if not self.levels.any():
            return query, leaf, np.zeros(len(query), dtype=np.int64)
        c0, c1 = self._place(leaf, x0[query], 0), self._place(leaf, x1[query], 0)
        r0, r1 = self._place(leaf, y0[query], 1), self._place(leaf, y1[query], 1)
        wide = c1 - c0 + 1
        n = wide * (r1 - r0 + 1)
        rep = np.repeat(np.arange(len(query)), n)
        step = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        column, row = c0[rep] + step % wide[rep], r0[rep] + step // wide[rep]
        return query[rep], leaf[rep], column + (row << self.levels[leaf[rep]])
