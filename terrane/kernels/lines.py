"""Merging the lines of one attribute set within a tile."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from terrane.kernels.geometry import Line, douglas_peucker, length


class Network:
    """Lines as edges between their end points."""

    def __init__(self, lines: list[Line], grid: float):
        self.grid, self.edges, self.at, self.next = grid, {}, defaultdict(set), 0
        for line in lines:
            self.add(np.asarray(line, dtype=float))

    def node(self, p) -> tuple[int, int]:
        return int(round(p[0] / self.grid)), int(round(p[1] / self.grid))

    def add(self, line: Line) -> None:
        if len(line) > 1 and length(line) > 0:
            self.edges[self.next] = line
            self.at[self.node(line[0])].add(self.next)
            self.at[self.node(line[-1])].add(self.next)
            self.next += 1

    def drop(self, k: int) -> Line:
        line = self.edges.pop(k)
        self.at[self.node(line[0])].discard(k)
        self.at[self.node(line[-1])].discard(k)
        return line

    def degree(self, node) -> int:
        return sum(2 if self.node(self.edges[k][0]) == self.node(self.edges[k][-1]) else 1 for k in self.at[node])

    def join(self, a: int, b: int, node) -> None:
        p, q = self.drop(a), self.drop(b)
        p = p if self.node(p[-1]) == node else p[::-1]
        q = q if self.node(q[0]) == node else q[::-1]
        self.add(np.vstack([p, q[1:]]))

    def merge_through(self) -> None:
        """Join the two edges of every node that has just two ends."""
        todo = list(self.at)
        while todo:
            node = todo.pop()
            ends = list(self.at[node])
            if len(ends) == 2 and self.degree(node) == 2:
                self.join(*sorted(ends), node)

    def loops(self) -> list[int]:
        return [k for k, e in self.edges.items() if self.node(e[0]) == self.node(e[-1])]


def split_at_nodes(lines: list[Line], grid: float) -> list[Line]:
    """Cut the lines wherever an inner point is an end or a shared point, and drop repeated segments."""
    key = lambda p: (int(round(p[0] / grid)), int(round(p[1] / grid)))
    count: dict = defaultdict(int)
    seen, chains = set(), []
    for line in lines:
        chain = [line[0]]
        for a, b in zip(line[:-1], line[1:]):
            ka, kb = key(a), key(b)
            if ka == kb:
                continue
            edge = (min(ka, kb), max(ka, kb))
            if edge in seen:
                if len(chain) > 1:
                    chains.append(np.array(chain))
                chain = [b]
                continue
            seen.add(edge)
            chain.append(b)
        if len(chain) > 1:
            chains.append(np.array(chain))
    for chain in chains:
        for k, p in enumerate(chain):
            count[key(p)] += 1 if 0 < k < len(chain) - 1 else 2
    out = []
    for chain in chains:
        start = 0
        for k in range(1, len(chain)):
            if k == len(chain) - 1 or count[key(chain[k])] > 1:
                out.append(chain[start : k + 1])
                start = k
    return out


def merge_lines(
    lines: list, min_length: float = 0.0, loop_min_length: float = 0.0, stub_min_length: float = 0.0, tolerance: float = -1.0, strokes: bool = False, max_turn: float = np.pi / 4, grid: float = 1 / 16
) -> list[Line]:
    """Lines that touch at their ends become one, in fixed steps: node and drop repeated segments, merge through nodes with two ends,
    break short loops, drop short stubs, simplify, drop repeats again, join strokes that go straight on, filter by length."""
    clean = [np.asarray(x, dtype=float) for x in lines if len(x) > 1]
    net = Network(split_at_nodes(clean, grid), grid)
    net.merge_through()
    if loop_min_length > 0:
        for k in net.loops():
            if k in net.edges and length(net.edges[k]) < loop_min_length:
                net.drop(k)
        _break_short_loops(net, loop_min_length)
        net.merge_through()
    if stub_min_length > 0:
        changed = True
        while changed:
            changed = False
            for k in sorted(net.edges, key=lambda k: length(net.edges[k])):
                e = net.edges.get(k)
                if e is None or length(e) >= stub_min_length:
                    continue
                a, b = net.degree(net.node(e[0])), net.degree(net.node(e[-1]))
                if (a == 1) != (b == 1):
                    net.drop(k)
                    changed = True
            net.merge_through()
    if tolerance >= 0:
        net = Network(split_at_nodes([douglas_peucker(e, tolerance) for e in net.edges.values()], grid), grid)
        net.merge_through()
    if strokes:
        _join_strokes(net, max_turn)
    return [e for _, e in sorted(net.edges.items()) if length(e) >= min_length]


def _break_short_loops(net: Network, limit: float) -> None:
    """Of edges that join the same two nodes, the longer ones of a loop below the limit go."""
    pairs: dict = defaultdict(list)
    for k, e in net.edges.items():
        a, b = net.node(e[0]), net.node(e[-1])
        if a != b:
            pairs[min(a, b), max(a, b)].append(k)
    for ks in pairs.values():
        ks.sort(key=lambda k: length(net.edges[k]))
        for k in ks[1:]:
            if length(net.edges[ks[0]]) + length(net.edges[k]) < limit:
                net.drop(k)


def _join_strokes(net: Network, max_turn: float) -> None:
    def away(k: int, node) -> np.ndarray:
        e = net.edges[k]
        d = e[1] - e[0] if net.node(e[0]) == node else e[-2] - e[-1]
        return d / max(float(np.hypot(*d)), 1e-300)

    for node in list(net.at):
        while True:
            ends = sorted(net.at[node])
            best = None
            for i, a in enumerate(ends):
                for b in ends[i + 1 :]:
                    turn = float(np.arccos(np.clip(-(away(a, node) @ away(b, node)), -1, 1)))
                    if turn <= max_turn and (best is None or turn < best[0]):
                        best = (turn, a, b)
            if best is None:
                break
            net.join(best[1], best[2], node)
