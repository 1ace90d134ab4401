"""Geometry in plain numpy: lines are (n, 2) arrays, polygons lists of closed rings (the first one outer)."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

Line = np.ndarray
Polygon = list


def closed(ring: Line) -> Line:
    ring = np.asarray(ring, dtype=float)
    return ring if len(ring) and (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])


def length(line: Line) -> float:
    return float(np.hypot(*np.diff(line, axis=0).T).sum()) if len(line) > 1 else 0.0


def signed_area(ring: Line) -> float:
    """Positive for counter-clockwise rings in a y-up plane."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def area(polygon: Polygon) -> float:
    return abs(signed_area(polygon[0])) - sum(abs(signed_area(r)) for r in polygon[1:])


def oriented(polygon: Polygon) -> Polygon:
    """Outer ring counter-clockwise, holes clockwise."""
    return [r if (signed_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(polygon)]


def line_centroid(line: Line) -> np.ndarray:
    steps = np.hypot(*np.diff(line, axis=0).T)
    return line.mean(axis=0) if not steps.sum() else ((line[:-1] + line[1:]) / 2 * steps[:, None]).sum(axis=0) / steps.sum()


def centroid(polygon: Polygon) -> np.ndarray:
    total, weight, base = np.zeros(2), 0.0, polygon[0][0]
    for k, ring in enumerate(oriented(polygon)):
        p = ring - base
        cross = p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]
        total += ((p[:-1] + p[1:]) * cross[:, None]).sum(axis=0) / 6
        weight += cross.sum() / 2
    return base + total / weight if weight else line_centroid(polygon[0])


def contains(polygon: Polygon, x: float, y: float) -> bool:
    inside = False
    for ring in polygon:
        a, b = ring[:-1], ring[1:]
        cross = (a[:, 1] > y) != (b[:, 1] > y)
        if cross.any():
            p, q = a[cross], b[cross]
            inside ^= bool(((q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0] > x).sum() % 2)
    return inside


def point_on_surface(polygon: Polygon) -> np.ndarray:
    """The middle of the widest inside stretch of a horizontal line near the middle."""
    ys = np.unique(np.concatenate([r[:, 1] for r in polygon]))
    middle = (ys[0] + ys[-1]) / 2
    k = int(np.clip(np.searchsorted(ys, middle), 1, len(ys) - 1)) if len(ys) > 1 else 0
    y = (ys[k - 1] + ys[k]) / 2 if k else middle
    crossings = []
    for ring in polygon:
        a, b = ring[:-1], ring[1:]
        cross = (a[:, 1] > y) != (b[:, 1] > y)
        p, q = a[cross], b[cross]
        crossings += ((q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0]).tolist()
    crossings.sort()
    spans = [(b - a, (a + b) / 2) for a, b in zip(crossings[::2], crossings[1::2])]
    return np.array([max(spans)[1], y]) if spans else polygon[0][0]


def boundary_distance(polygon: Polygon, x: float, y: float) -> float:
    """Distance to the boundary, negative outside."""
    best = np.inf
    for ring in polygon:
        a, d = ring[:-1], np.diff(ring, axis=0)
        squares = (d**2).sum(axis=1)
        t = np.clip((((x, y) - a) * d).sum(axis=1) / np.where(squares == 0, 1, squares), 0, 1)
        best = min(best, float(np.hypot(*((a + d * t[:, None]) - (x, y)).T).min()))
    return best if contains(polygon, x, y) else -best


def innermost_point(polygon: Polygon, tolerance: float = 0.1) -> np.ndarray:
    """The point farthest inside, to within tolerance * sqrt(area): cells are split best first."""
    low, high = polygon[0].min(axis=0), polygon[0].max(axis=0)
    long_side = float(max(high - low))
    size = max(float(min(high - low)), long_side / 64)  # a thin shape starts with few cells too
    if min(high - low) == 0:
        return low
    precision = max(tolerance * np.sqrt(max(area(polygon), 0.0)), long_side * 1e-3)  # a shape without area has an end as well
    half = size / 2
    heap: list[tuple[float, float, float, float, float]] = []

    def push(x: float, y: float, h: float) -> None:
        d = boundary_distance(polygon, x, y)
        heapq.heappush(heap, (-(d + h * np.sqrt(2)), x, y, h, d))

    for x in np.arange(low[0], high[0], size):
        for y in np.arange(low[1], high[1], size):
            push(x + half, y + half, half)
    c = centroid(polygon)
    best = (boundary_distance(polygon, *c), c[0], c[1])
    while heap:
        bound, x, y, h, d = heapq.heappop(heap)
        best = max(best, (d, x, y))
        if -bound - best[0] <= precision:
            break
        for dx in (-h / 2, h / 2):
            for dy in (-h / 2, h / 2):
                push(x + dx, y + dy, h / 2)
    return np.array(best[1:])


def along(line: Line, share: float) -> np.ndarray:
    """The point at a share of the length."""
    if not 0 <= share <= 1:
        raise ValueError("the share must be between 0 and 1")
    run = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))])
    return np.array([np.interp(share * run[-1], run, line[:, 0]), np.interp(share * run[-1], run, line[:, 1])])


def part(line: Line, start: float, end: float) -> Line:
    """The stretch between two shares of the length, with interpolated ends."""
    if not 0 <= start <= end <= 1:
        raise ValueError("the shares must ascend between 0 and 1")
    run = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))])
    a, b = start * run[-1], end * run[-1]
    inner = line[(run > a) & (run < b)]
    return np.vstack([along(line, start), inner, along(line, end)])


def is_convex(ring: Line, tolerance: float = 1e-9) -> bool:
    d = np.diff(ring, axis=0)
    d = d[(d != 0).any(axis=1)]
    turn = d[:, 0] * np.roll(d[:, 1], -1) - d[:, 1] * np.roll(d[:, 0], -1)
    slack = tolerance * np.abs(turn).max() if len(turn) else 0
    return bool((turn >= -slack).all() or (turn <= slack).all())


def centroid_if_convex(polygon: Polygon) -> np.ndarray | None:
    return centroid(polygon) if len(polygon) == 1 and is_convex(polygon[0]) else None


def douglas_peucker(line: Line, tolerance: float, ring: bool = False) -> Line:
    """Points farther than the tolerance from the chord stay; a ring keeps two inner points at least."""
    n = len(line)
    if n < 3 or tolerance <= 0:
        return line
    keep = np.zeros(n, dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, n - 1, 2 if ring else 0)]
    while todo:
        a, b, need = todo.pop()
        if b - a < 2:
            continue
        inner, d = line[a + 1 : b] - line[a], line[b] - line[a]
        square = float(d @ d)
        t = np.clip(inner @ d / square, 0, 1)[:, None] if square else 0.0
        distance = ((inner - d * t) ** 2).sum(axis=1)
        k = int(distance.argmax())
        if distance[k] > tolerance**2 or need:
            m = a + 1 + k
            keep[m] = True
            left = max(0, need - 1)
            longer = (m - a) >= (b - m)
            todo += [(a, m, left if longer else 0), (m, b, 0 if longer else left)]
    return line[keep]


def visvalingam(line: Line, tolerance: float, weight: float = 0.0, ring: bool = False) -> Line:
    """Drop points whose triangle with their neighbours has less than tolerance**2 area, flat ones first with a weight above 0."""
    n, least = len(line), 4 if ring else 2
    if n <= least or tolerance <= 0:
        return line
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def cost(k: int) -> float:
        a, b, c = line[before[k]], line[k], line[after[k]]
        base = abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2
        if not weight:
            return base
        u, v = a - b, c - b
        norm = float(np.hypot(*u) * np.hypot(*v))
        cosine = float(u @ v) / norm if norm else 0.0
        return base * (1 + weight * cosine)

    costs = {k: cost(k) for k in range(1, n - 1)}
    heap = [(v, k) for k, v in costs.items()]
    heapq.heapify(heap)
    left = n
    while heap and left > least:
        value, k = heapq.heappop(heap)
        if not alive[k] or value != costs[k]:
            continue
        if value >= tolerance**2:
            break
        alive[k] = False
        left -= 1
        after[before[k]], before[after[k]] = after[k], before[k]
        for j in (before[k], after[k]):
            if 0 < j < n - 1 and alive[j]:
                costs[j] = max(cost(j), value)
                heapq.heappush(heap, (costs[j], j))
    return line[np.array(alive)]


def midpoint_smooth(line: Line, times: int = 1) -> Line:
    """Replace the inner points by the middles of the segments; ends stay, rings stay closed."""
    for _ in range(times):
        middles = (line[:-1] + line[1:]) / 2
        ring = len(line) > 3 and (line[0] == line[-1]).all()
        line = closed(middles) if ring else np.vstack([line[:1], middles, line[-1:]])
    return line


def chaikin(line: Line, times: int = 1, least_area: float = 0.0) -> Line:
    """Cut every inner corner at a quarter of both sides; corners whose cut-off triangle is smaller than ``least_area`` stay."""
    for _ in range(times):
        ring = len(line) > 3 and (line[0] == line[-1]).all()
        p = np.vstack([line[-2:-1], line]) if ring else line
        out = [] if ring else [line[0]]
        for a, b, c in zip(p[:-2], p[1:-1], p[2:]):
            cut = abs((a[0] - b[0]) * (c[1] - b[1]) - (c[0] - b[0]) * (a[1] - b[1])) / 32
            out += [b * 0.75 + a * 0.25, b * 0.75 + c * 0.25] if cut > least_area else [b]
        line = closed(np.array(out)) if ring else np.vstack([*out, line[-1]])
    return line


def pipeline(*steps: Callable[[Line], Line]) -> Callable[[Line], Line]:
    """One step after the other."""

    def run(line: Line) -> Line:
        for step in steps:
            line = step(line)
        return line

    return run


def clip_line(line: Line, x0: float, y0: float, x1: float, y1: float) -> list[Line]:
    """The stretches of a line inside a closed box."""
    out: list[Line] = []
    run: list[tuple[float, float]] = []
    for (ax, ay), (bx, by) in zip(line[:-1].tolist(), line[1:].tolist()):
        t0, t1, dx, dy, ok = 0.0, 1.0, bx - ax, by - ay, True
        for p, q in ((-dx, ax - x0), (dx, x1 - ax), (-dy, ay - y0), (dy, y1 - ay)):
            if p == 0:
                ok &= q >= 0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if not ok or t0 > t1:
            if len(run) > 1:
                out.append(np.array(run))
            run = []
            continue
        a, b = (ax + t0 * dx, ay + t0 * dy), (ax + t1 * dx, ay + t1 * dy)
        if not run or run[-1] != a:
            if len(run) > 1:
                out.append(np.array(run))
            run = [a]
        if b != a:
            run.append(b)
        if t1 < 1:
            if len(run) > 1:
                out.append(np.array(run))
            run = []
    if len(run) > 1:
        out.append(np.array(run))
    return out


def clip_ring(ring: Line, low: float, high: float, axis: int) -> Line:
    """A ring cut by the strip low..high of one axis, edges along the strip's sides included."""
    for bound, sign in ((low, 1.0), (high, -1.0)):
        if len(ring) < 4:
            return ring[:0]
        v = (ring[:, axis] - bound) * sign
        inside = v >= 0
        if inside.all():
            continue
        if not inside.any():
            return ring[:0]
        a, b = ring[:-1], ring[1:]
        va, vb = v[:-1], v[1:]
        cross = inside[:-1] != inside[1:]
        t = np.divide(va, va - vb, out=np.zeros_like(va), where=cross)
        cut = a + (b - a) * t[:, None]
        cut[cross, axis] = bound
        pieces = np.empty((2 * len(a), 2))
        pieces[0::2], pieces[1::2] = a, cut
        keep = np.empty(2 * len(a), dtype=bool)
        keep[0::2], keep[1::2] = inside[:-1], cross
        ring = pieces[keep]
        ring = closed(ring) if len(ring) else ring
    return ring if len(ring) >= 4 else ring[:0]


def clip_polygon(polygon: Polygon, x0: float, y0: float, x1: float, y1: float) -> Polygon:
    """The polygon inside a box; no rings if nothing is left of the outer one."""
    out = []
    for k, ring in enumerate(polygon):
        r = clip_ring(clip_ring(ring, x0, x1, 0), y0, y1, 1)
        if len(r) >= 4 and abs(signed_area(r)) > 0:
            out.append(r)
        elif k == 0:
            return []
    return out


def slice_line(line: Line, zoom: int, buffer: float = 4.0, extents: tuple[int, int, int, int] | None = None) -> list[tuple[int, int, list[Line], bool]]:
    """(column, row, stretches in tile pixels, False) for every tile whose buffered square a line in world coordinates meets.

    All segments are cut by all columns that they cross and by all rows that they cross there in one go; stretches that
    follow each other in a tile are joined.
    """
    n, b = 1 << zoom, buffer / 256.0
    p = np.asarray(line, dtype=float) * n
    if len(p) < 2:
        return []
    a, d = p[:-1], np.diff(p, axis=0)

    def spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which row, and which whole number from floor(low - b) to floor(high + b) of it."""
        first = np.floor(low - b).astype(np.int64)
        times = np.maximum(np.floor(high + b).astype(np.int64) - first + 1, 0)
        which = np.repeat(np.arange(len(first)), times)
        return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)

    def window(start: np.ndarray, step: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of 0..1 over which start + t * step is in the buffered cell."""
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = (cell - b - start) / step, (cell + 1 + b - start) / step
        t0, t1 = np.minimum(u, v), np.maximum(u, v)
        still = step == 0
        inside = (start >= cell - b) & (start <= cell + 1 + b)
        t0[still], t1[still] = np.where(inside[still], 0.0, 2.0), np.where(inside[still], 1.0, -1.0)
        return np.maximum(t0, 0.0), np.minimum(t1, 1.0)

    seg, column = spans(np.minimum(p[:-1, 0], p[1:, 0]), np.maximum(p[:-1, 0], p[1:, 0]))
    t0, t1 = window(a[seg, 0], d[seg, 0], column)
    y0, y1 = a[seg, 1] + t0 * d[seg, 1], a[seg, 1] + t1 * d[seg, 1]
    which, row = spans(np.where(t0 <= t1, np.minimum(y0, y1), 1.0), np.where(t0 <= t1, np.maximum(y0, y1), -1.0 - 2 * b))
    x_low, y_low, x_high, y_high = extents or (0, 0, n, n)
    wrapped = column % n
    fits = (row >= max(0, y_low)) & (row < min(n, y_high)) & (wrapped[which] >= x_low) & (wrapped[which] < x_high)
    which, row = which[fits], row[fits]
    seg, column, t0, t1 = seg[which], column[which], t0[which], t1[which]
    s0, s1 = window(a[seg, 1], d[seg, 1], row)
    t0, t1 = np.maximum(t0, s0), np.minimum(t1, s1)
    keep = t0 < t1
    seg, column, row, t0, t1 = seg[keep], column[keep], row[keep], t0[keep], t1[keep]
    if not len(seg):
        return []
    order = np.lexsort((seg, row, column))
    seg, column, row, t0, t1 = seg[order], column[order], row[order], t0[order], t1[order]
    new_tile = np.ones(len(seg), dtype=bool)
    new_tile[1:] = (column[1:] != column[:-1]) | (row[1:] != row[:-1])
    opens = new_tile.copy()
    opens[1:] |= (seg[1:] != seg[:-1] + 1) | (t1[:-1] < 1) | (t0[1:] > 0)
    corner = np.stack([column, row], axis=1)
    starts = np.where((t0 == 0)[:, None], a[seg], a[seg] + t0[:, None] * d[seg])
    ends = np.where((t1 == 1)[:, None], p[seg + 1], a[seg] + t1[:, None] * d[seg])
    starts, ends = (starts - corner) * 256, (ends - corner) * 256
    out: list[tuple[int, int, list[Line], bool]] = []
    bounds = np.append(np.flatnonzero(opens), len(seg)).tolist()
    for low, high in zip(bounds, bounds[1:]):
        stretch = np.concatenate([starts[low : low + 1], ends[low:high]])
        if new_tile[low]:
            out.append((int(column[low]) % n, int(row[low]), [stretch], False))
        else:
            out[-1][2].append(stretch)
    return out


def slice_to_tiles(kind: str, shape, zoom: int, buffer: float = 4.0, extents: tuple[int, int, int, int] | None = None) -> list[tuple[int, int, object, bool]]:
    """(column, row, shape in tile pixels, filled) for every tile that a line or polygon in world coordinates meets.

    A polygon is cut into column strips first and each strip into rows, so every point is visited about once per strip and not once
    per tile. Tiles wholly inside a polygon are told as filled, without cutting. Columns wrap around the antimeridian.
    """
    if kind == "line":
        return slice_line(shape, zoom, buffer, extents)
    n = 1 << zoom
    b = buffer / 256.0
    lines = [closed(r) * n for r in shape]
    low, high = lines[0].min(axis=0), lines[0].max(axis=0)
    first_row, last_row = max(0, int(np.floor(low[1] - b))), min(n - 1, int(np.floor(high[1] + b)))
    x_low, y_low, x_high, y_high = extents or (0, 0, n, n)
    out = []
    for column in range(int(np.floor(low[0] - b)), int(np.floor(high[0] + b)) + 1):
        wrapped = column % n
        if not x_low <= wrapped < x_high:
            continue
        strip = [r for r in (clip_ring(r, column - b, column + 1 + b, 0) for r in lines) if len(r) >= 4]
        edges = np.concatenate([np.stack([r[:-1, 1], r[1:, 1]], axis=1)[(r[:-1, 0] != r[1:, 0]) | ((r[:-1, 0] > column - b) & (r[:-1, 0] < column + 1 + b))] for r in strip]) if strip else np.zeros((0, 2))
        top, bottom = max(first_row, y_low), min(last_row, y_high - 1)
        if not strip or bottom < top:
            continue
        touched = np.zeros(bottom - top + 1, dtype=bool)
        first, last = np.floor(edges.min(axis=1) - b).astype(int) - top, np.floor(edges.max(axis=1) + b).astype(int) - top
        for a, z in zip(np.clip(first, 0, len(touched)), np.clip(last + 1, 0, len(touched))):
            touched[a:z] = True
        inside: bool | None = None  # rows that no edge meets are all in or all out until the next edge
        for k, crossed in enumerate(touched):
            row = top + k
            if not crossed:
                inside = contains(strip, column + 0.5, row + 0.5) if inside is None else inside
                if inside:
                    out.append((wrapped, row, [[fill_ring(buffer)]], True))
                continue
            inside = None
            cut = [r for r in (clip_ring(r, row - b, row + 1 + b, 1) for r in strip) if len(r) >= 4 and abs(signed_area(r)) > 1e-12]
            if cut:
                out.append((wrapped, row, [[(r - (column, row)) * 256 for r in cut]], False))
    return out


def fill_ring(buffer: float) -> Line:
    a, z = -buffer, 256 + buffer
    return np.array([[a, a], [z, a], [z, z], [a, z], [a, a]])


def covered_tiles(kind: str, shape, zoom: int) -> set[tuple[int, int]]:
    """Tiles that the shape touches, without a buffer."""
    return {(x, y) for x, y, _, _ in slice_to_tiles(kind, shape, zoom, 0.0)}


def is_fill(ring: Line, buffer: float = 0.0) -> bool:
    """Whether a ring in tile pixels covers the whole tile."""
    low, high = ring.min(axis=0), ring.max(axis=0)
    if (low > -buffer).any() or (high < 256 + buffer).any():
        return False
    return abs(abs(signed_area(ring)) - float(np.prod(high - low))) < 1e-9 * float(np.prod(high - low))


def overlay(groups: list[list[Polygon]], keep: Callable[[np.ndarray], np.ndarray], grid: float = 1e-6) -> list[Polygon]:
    """Boolean combination of groups of polygons.

    All edges are snapped to a grid and split where they meet. ``keep`` says for rows of winding numbers, one column per group, whether
    such a place is inside the result; the pieces with the inside on one side only are joined to rings, which are nested again.
    """
    segments, owners = [], []
    for g, polygons in enumerate(groups):
        for polygon in polygons:
            for ring in oriented([closed(r) for r in polygon]):
                r = np.round(np.asarray(ring) / grid) * grid
                seg = np.hstack([r[:-1], r[1:]])
                seg = seg[(seg[:, :2] != seg[:, 2:]).any(axis=1)]
                segments.append(seg)
                owners.append(np.full(len(seg), g))
    if not segments:
        return []
    seg, owner = np.concatenate(segments), np.concatenate(owners)
    pieces = np.unique(np.array([min((tuple(p[:2]), tuple(p[2:])), (tuple(p[2:]), tuple(p[:2]))) for p in _split(seg, grid)]).reshape(-1, 4), axis=0)
    pieces = pieces[(pieces[:, :2] != pieces[:, 2:]).any(axis=1)]
    middle, d = (pieces[:, :2] + pieces[:, 2:]) / 2, pieces[:, 2:] - pieces[:, :2]
    normal = np.stack([-d[:, 1], d[:, 0]], axis=1) / np.hypot(d[:, 0], d[:, 1])[:, None] * grid * 0.25
    left = keep(_windings(middle + normal, seg, owner, len(groups)))
    right = keep(_windings(middle - normal, seg, owner, len(groups)))
    kept = np.concatenate([pieces[left & ~right], pieces[right & ~left][:, [2, 3, 0, 1]]])  # the inside on the left
    return nest(_rings(kept))


def _split(seg: np.ndarray, grid: float) -> np.ndarray:
    out = []
    lo, hi = np.minimum(seg[:, :2], seg[:, 2:]), np.maximum(seg[:, :2], seg[:, 2:])
    for k in range(len(seg)):
        a, d = seg[k, :2], seg[k, 2:] - seg[k, :2]
        near = np.flatnonzero((lo <= hi[k] + grid).all(axis=1) & (hi >= lo[k] - grid).all(axis=1))
        c, e = seg[near, :2], seg[near, 2:] - seg[near, :2]
        cross = d[0] * e[:, 1] - d[1] * e[:, 0]
        ac = c - a
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (ac[:, 0] * e[:, 1] - ac[:, 1] * e[:, 0]) / cross
            u = (ac[:, 0] * d[1] - ac[:, 1] * d[0]) / cross
        ok = (cross != 0) & (t > 0) & (t < 1) & (u >= -1e-12) & (u <= 1 + 1e-12)
        points = [a + d * v for v in t[ok]]
        size = float(d @ d)
        for p in np.concatenate([c, c + e]):  # ends of others that lie on this edge
            v = float((p - a) @ d) / size
            if 0 < v < 1 and abs(d[0] * (p[1] - a[1]) - d[1] * (p[0] - a[0])) <= grid * np.sqrt(size):
                points.append(p)
        chain = np.array([a, *points, a + d])
        chain = np.round(chain[np.argsort((chain - a) @ d, kind="stable")] / grid) * grid
        out.append(np.hstack([chain[:-1], chain[1:]]))
    return np.concatenate(out)


def _windings(points: np.ndarray, seg: np.ndarray, owner: np.ndarray, groups: int) -> np.ndarray:
    out = np.zeros((len(points), groups), dtype=int)
    a, b = seg[:, :2], seg[:, 2:]
    for start in range(0, len(points), 512):
        p = points[start : start + 512]
        y = p[:, 1][:, None]
        up, down = (a[:, 1] <= y) & (b[:, 1] > y), (a[:, 1] > y) & (b[:, 1] <= y)
        side = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (p[:, 0][:, None] - a[:, 0]) * (b[:, 1] - a[:, 1])
        # side > 0: the point lies left of an upward edge, so a ray to the right crosses it
        turn = (up & (side > 0)).astype(int) - (down & (side < 0)).astype(int)
        for g in range(groups):
            out[start : start + 512, g] = turn[:, owner == g].sum(axis=1)
    return out


def _rings(edges: np.ndarray) -> list[Line]:
    """Closed rings of directed edges; at a crossing the sharpest left turn is taken, which keeps touching rings apart."""
    leaving: dict[tuple, list[tuple]] = {}
    for ax, ay, bx, by in edges.tolist():
        leaving.setdefault((ax, ay), []).append((bx, by))
    rings = []
    while leaving:
        start = min(leaving)
        path = [start]
        here, before = start, None
        while True:
            choices = leaving.get(here)
            if not choices:
                break
            if len(choices) == 1 or before is None:
                step = choices.pop()
            else:
                back = np.arctan2(before[1] - here[1], before[0] - here[0])
                turns = [(back - np.arctan2(c[1] - here[1], c[0] - here[0])) % (2 * np.pi) for c in choices]
                step = choices.pop(int(np.argmin(turns)))
            if not choices:
                del leaving[here]
            before, here = here, step
            path.append(here)
            if here == start:
                break
        if path[0] == path[-1] and len(path) >= 4:
            rings.append(_straightened(np.array(path)))
    return [r for r in rings if len(r) >= 4]


def _straightened(ring: Line) -> Line:
    """Without points on a straight edge."""
    p = ring[:-1]
    while len(p) > 3:
        a, c = np.roll(p, 1, axis=0), np.roll(p, -1, axis=0)
        turn = (p[:, 0] - a[:, 0]) * (c[:, 1] - p[:, 1]) - (p[:, 1] - a[:, 1]) * (c[:, 0] - p[:, 0])
        flat = np.abs(turn) <= 1e-12 * np.maximum(1e-300, np.hypot(*(p - a).T) * np.hypot(*(c - p).T))
        if not flat.any():
            break
        p = np.delete(p, np.flatnonzero(flat)[0], axis=0)
    return closed(p)


def nest(rings: list[Line]) -> list[Polygon]:
    """Polygons of rings by containment: even depth is outer, odd depth a hole of the smallest ring around it."""
    rings = sorted((closed(r) for r in rings), key=lambda r: -abs(signed_area(r)))
    depth, parent = [], []
    for k, ring in enumerate(rings):
        probe = point_on_surface([ring])
        around = [j for j in range(k) if contains([rings[j]], *probe)]
        depth.append(len(around))
        parent.append(around[-1] if around else -1)
    polygons = {k: [r] for k, r in enumerate(rings) if depth[k] % 2 == 0}
    for k, r in enumerate(rings):
        if depth[k] % 2 and parent[k] in polygons:
            polygons[parent[k]].append(r)
    return [oriented(p) for p in polygons.values()]


def nest_all(shapes: list[list[Line]]) -> list[Polygon]:
    """The polygons of several shapes, each given as loose rings."""
    return [p for rings in shapes for p in nest([r for r in rings if len(r) >= 4])]


def union(polygons: list[Polygon], grid: float = 1e-6) -> list[Polygon]:
    return overlay([polygons], lambda w: w[:, 0] != 0, grid)


def clusters(polygons: list[Polygon]) -> list[list[Polygon]]:
    """Groups of polygons whose boxes touch, directly or through others: only these can have anything in common."""
    boxes = np.array([[*p[0].min(axis=0), *p[0].max(axis=0)] for p in polygons]).reshape(-1, 4)
    order = np.argsort(boxes[:, 0], kind="stable")
    owner = list(range(len(polygons)))

    def root(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    open_: list[int] = []
    for k in order.tolist():
        open_ = [j for j in open_ if boxes[j, 2] >= boxes[k, 0]]
        for j in open_:
            if boxes[j, 1] <= boxes[k, 3] and boxes[k, 1] <= boxes[j, 3]:
                owner[root(j)] = root(k)
        open_.append(k)
    found: dict[int, list[Polygon]] = {}
    for k, polygon in enumerate(polygons):
        found.setdefault(root(k), []).append(polygon)
    return list(found.values())


def merged_union(polygons: list[Polygon], grid: float = 1e-6) -> list[Polygon]:
    """``union`` of each cluster; polygons that meet no other stay as they are."""
    return [q for some in clusters(polygons) for q in (some if len(some) == 1 else union(some, grid))]


def difference(a: list[Polygon], b: list[Polygon], grid: float = 1e-6) -> list[Polygon]:
    return overlay([a, b], lambda w: (w[:, 0] != 0) & (w[:, 1] == 0), grid)


def _band(polygons: list[Polygon], distance: float, corners: int = 8) -> list[Polygon]:
    """Everything within a distance of the rings, as overlapping pieces."""
    angles = np.arange(corners) * 2 * np.pi / corners + np.pi / corners
    disc = np.stack([np.cos(angles), np.sin(angles)], axis=1) * distance / np.cos(np.pi / corners)
    pieces = []
    for polygon in polygons:
        for ring in polygon:
            for a, b in zip(ring[:-1], ring[1:]):
                d = b - a
                size = np.hypot(*d)
                if size:
                    n = np.array([-d[1], d[0]]) / size * distance
                    pieces.append([closed(np.array([a + n, a - n, b - n, b + n]))])
                pieces.append([closed(disc + a)])
    return pieces


def buffered(polygons: list[Polygon], distance: float, grid: float = 1e-6) -> list[Polygon]:
    """Grown, or with a negative distance shrunk, by a distance (corners as octagons)."""
    if not polygons or distance == 0:
        return union(polygons, grid)
    band = _band(polygons, abs(distance))
    return union([*polygons, *band], grid) if distance > 0 else difference(polygons, band, grid)


def snapped(polygon: Polygon, step: float = 1 / 16) -> list[Polygon]:
    """Rounded to a grid and made valid again."""
    rings = [np.round(closed(r) / step) * step for r in polygon]
    return [p for p in overlay([[rings]], lambda w: w[:, 0] != 0, step / 64) if abs(signed_area(p[0])) > 0]


def assemble(segments: list[Line], gap: float = 1e-9) -> list[Polygon]:
    """Polygons from way segments in any order and direction: ends are joined to rings, small gaps closed, rings nested; roles are ignored."""
    ends: dict[tuple, list[int]] = {}
    pieces = [np.asarray(s, dtype=float) for s in segments if len(s) > 1]
    key = lambda p: tuple(np.round(p / gap).astype(np.int64)) if gap else tuple(p)
    rings = [p for p in pieces if key(p[0]) == key(p[-1]) and len(p) >= 4]
    todo = [p for p in pieces if key(p[0]) != key(p[-1])]
    for k, p in enumerate(todo):
        ends.setdefault(key(p[0]), []).append(k)
        ends.setdefault(key(p[-1]), []).append(k)
    used = [False] * len(todo)
    for k, p in enumerate(todo):
        if used[k]:
            continue
        used[k], chain = True, p
        while key(chain[0]) != key(chain[-1]):
            other = next((j for j in ends.get(key(chain[-1]), []) if not used[j]), None)
            if other is None:
                break
            used[other] = True
            q = todo[other]
            chain = np.vstack([chain, (q if key(q[0]) == key(chain[-1]) else q[::-1])[1:]])
        if key(chain[0]) == key(chain[-1]) and len(chain) >= 4:
            chain = chain.copy()
            chain[-1] = chain[0]
            rings.append(chain)
    return nest([closed(r) for r in rings if abs(signed_area(closed(r))) > 0])
