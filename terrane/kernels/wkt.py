"""Reading polygons from text and testing points against them."""

from __future__ import annotations

import re

import numpy as np

_RING = re.compile(r"\(([^()]*)\)")


def polygons(text: str | None) -> list[list[np.ndarray]]:
    """Polygons of a POLYGON or MULTIPOLYGON text, each a list of rings (the first one outer) of shape (n, 2). Unreadable: none."""
    if not text:
        return []
    body = re.sub(r"(?i)^\s*SRID\s*=\s*\d+\s*;", "", text).strip()
    kind = re.match(r"(?i)(MULTIPOLYGON|POLYGON)\s*(?:Z|M|ZM)?\s*\(", body)
    if not kind:
        return []
    try:
        if kind.group(1).upper() == "POLYGON":
            parts = [body]
        else:
            parts = re.split(r"\)\s*\)\s*,", body)
            parts = [p + "))" for p in parts[:-1]] + [parts[-1]]
        found = []
        for part in parts:
            rings = [np.array([[float(v) for v in pair.split()[:2]] for pair in ring.split(",")]) for ring in _RING.findall(part)]
            if rings:
                found.append(rings)
        return found
    except ValueError:
        return []


def in_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of many points against one closed ring with straight edges."""
    x1, y1 = ring[:, 0], ring[:, 1]
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    inside = np.zeros(len(x), dtype=bool)
    for a, b, c, d in zip(x1, y1, x2, y2):
        if b == d:
            continue
        cross = (b > y) != (d > y)
        inside ^= cross & (x < (c - a) * (y - b) / (d - b) + a)
    return inside


def in_polygons(x: np.ndarray, y: np.ndarray, parts: list[list[np.ndarray]]) -> np.ndarray:
    """Whether each point lies in any of the polygons, outside that polygon's holes."""
    result = np.zeros(len(x), dtype=bool)
    for rings in parts:
        outer = rings[0]
        near = (x >= outer[:, 0].min()) & (x <= outer[:, 0].max()) & (y >= outer[:, 1].min()) & (y <= outer[:, 1].max()) & ~result
        rows = np.flatnonzero(near)
        if not len(rows):
            continue
        ok = in_ring(x[rows], y[rows], outer)
        for hole in rings[1:]:
            ok &= ~in_ring(x[rows], y[rows], hole)
        result[rows[ok]] = True
    return result


def bounds(parts: list[list[np.ndarray]]) -> tuple[float, float, float, float] | None:
    if not parts:
        return None
    every = np.concatenate([rings[0] for rings in parts])
    return float(every[:, 0].min()), float(every[:, 1].min()), float(every[:, 0].max()), float(every[:, 1].max())
