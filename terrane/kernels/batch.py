"""The kernels of a map build over many lines or rings at once.

Lines and rings are flat: (n, 2) points and ``offsets``, where line k is points[offsets[k]:offsets[k + 1]]. The functions give what their
namesakes in ``geometry`` and ``lines`` give for each line alone; only the cost of a call is shared.
"""

from __future__ import annotations

import numpy as np

from terrane.kernels import geometry as g

#: Pairs of edges or of points and edges that are held at a time.
PAIRS = 1 << 20


def repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every item repeated ``counts`` times: which item, and the number of the repetition."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def taken(offsets: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point numbers of some lines, in their order, and their offsets."""
    counts = (offsets[1:] - offsets[:-1])[lines]
    which, rank = repeated(counts)
    return offsets[:-1][lines][which] + rank, offsets_of(counts)


def segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point at which each segment starts, and its line."""
    which, rank = repeated(np.maximum(offsets[1:] - offsets[:-1] - 1, 0))
    return offsets[:-1][which] + rank, which


def lengths(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at, line = segments(offsets)
    d = points[at + 1] - points[at]
    return np.bincount(line, np.hypot(d[:, 0], d[:, 1]), len(offsets) - 1)


def signed_areas(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at, ring = segments(offsets)
    base = points[offsets[:-1][ring]]
    a, b = points[at] - base, points[at + 1] - base
    return np.bincount(ring, a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1], len(offsets) - 1) / 2


def douglas_peucker(points: np.ndarray, offsets: np.ndarray, tolerance: float, ring: bool = False) -> tuple[np.ndarray, np.ndarray]:
    if tolerance <= 0 or not len(points):
        return points, offsets
    keep = np.zeros(len(points), dtype=bool)
    some = offsets[1:] > offsets[:-1]
    a, b = offsets[:-1][some], offsets[1:][some] - 1
    keep[a] = keep[b] = True
    need = np.full(len(a), 2 if ring else 0)
    while True:
        live = b - a >= 2
        a, b, need = a[live], b[live], need[live]
        if not len(a):
            break
        n = b - a - 1
        which, rank = repeated(n)
        at = a[which] + 1 + rank
        d = points[b] - points[a]
        square = (d**2).sum(axis=1)
        d, square, inner = d[which], square[which], points[at] - points[a][which]
        t = np.divide((inner * d).sum(axis=1), square, out=np.zeros(len(at)), where=square != 0)
        distance = ((inner - d * np.clip(t, 0, 1)[:, None]) ** 2).sum(axis=1)
        best = np.maximum.reduceat(distance, np.cumsum(n) - n)
        hit = np.flatnonzero(distance == best[which])
        m = at[hit[np.concatenate([[True], which[hit][1:] != which[hit][:-1]])]]
        go = (best > tolerance**2) | (need > 0)
        a, b, m, left = a[go], b[go], m[go], np.maximum(need[go] - 1, 0)
        keep[m] = True
        longer = (m - a) >= (b - m)
        a, b, need = np.concatenate([a, m]), np.concatenate([m, b]), np.concatenate([np.where(longer, left, 0), np.where(longer, 0, left)])
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def slice_lines(points: np.ndarray, offsets: np.ndarray, zoom: int, buffer: np.ndarray, extents: tuple[int, int, int, int] | None = None):
    """(line, column, row, number of stretches) of every tile that the buffered lines meet, the points and the offsets of all stretches."""
    n = 1 << zoom
    p = points * n
    at, line = segments(offsets)
    a, d, b = p[at], p[at + 1] - p[at], (buffer / 256.0)[line]
    p1 = p[at + 1]

    def spans(low: np.ndarray, high: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.floor(low - b).astype(np.int64)
        which, rank = repeated(np.maximum(np.floor(high + b).astype(np.int64) - first + 1, 0))
        return which, first[which] + rank

    def window(start: np.ndarray, step: np.ndarray, cell: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = (cell - b - start) / step, (cell + 1 + b - start) / step
        t0, t1 = np.minimum(u, v), np.maximum(u, v)
        still = step == 0
        inside = (start >= cell - b) & (start <= cell + 1 + b)
        t0[still], t1[still] = np.where(inside[still], 0.0, 2.0), np.where(inside[still], 1.0, -1.0)
        return np.maximum(t0, 0.0), np.minimum(t1, 1.0)

    seg, column = spans(np.minimum(a[:, 0], p1[:, 0]), np.maximum(a[:, 0], p1[:, 0]), b)
    t0, t1 = window(a[seg, 0], d[seg, 0], column, b[seg])
    y0, y1 = a[seg, 1] + t0 * d[seg, 1], a[seg, 1] + t1 * d[seg, 1]
    which, row = spans(np.where(t0 <= t1, np.minimum(y0, y1), 1.0), np.where(t0 <= t1, np.maximum(y0, y1), -1.0 - 2 * b[seg]), b[seg])
    x_low, y_low, x_high, y_high = extents or (0, 0, n, n)
    wrapped = column % n
    fits = (row >= max(0, y_low)) & (row < min(n, y_high)) & (wrapped[which] >= x_low) & (wrapped[which] < x_high)
    which, row = which[fits], row[fits]
    seg, column, t0, t1 = seg[which], column[which], t0[which], t1[which]
    s0, s1 = window(a[seg, 1], d[seg, 1], row, b[seg])
    t0, t1 = np.maximum(t0, s0), np.minimum(t1, s1)
    keep = t0 < t1
    seg, column, row, t0, t1 = seg[keep], column[keep], row[keep], t0[keep], t1[keep]
    order = np.lexsort((seg, row, column, line[seg]))
    seg, column, row, t0, t1 = seg[order], column[order], row[order], t0[order], t1[order]
    of = line[seg]
    new_tile, opens = np.ones(len(seg), dtype=bool), np.ones(len(seg), dtype=bool)
    new_tile[1:] = (column[1:] != column[:-1]) | (row[1:] != row[:-1]) | (of[1:] != of[:-1])
    opens[1:] = new_tile[1:] | (seg[1:] != seg[:-1] + 1) | (t1[:-1] < 1) | (t0[1:] > 0)
    corner = np.stack([column, row], axis=1)
    starts = np.where((t0 == 0)[:, None], a[seg], a[seg] + t0[:, None] * d[seg])
    ends = np.where((t1 == 1)[:, None], p1[seg], a[seg] + t1[:, None] * d[seg])
    flat, stretches = chained((starts - corner) * 256, (ends - corner) * 256, opens)
    tile = np.cumsum(new_tile) - 1
    first = np.flatnonzero(new_tile)
    return of[first], column[first] % n, row[first], np.bincount(tile[opens], minlength=len(first)), flat, stretches


def chained(starts: np.ndarray, ends: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points and offsets of lines whose segments follow each other; ``opens`` marks the first one of each."""
    at = np.arange(len(opens)) + np.cumsum(opens)
    out = np.empty((len(opens) + int(opens.sum()), 2))
    out[at] = ends
    out[at[opens] - 1] = starts[opens]
    return out, np.append(at[opens] - 1, len(out)).astype(np.int64)


def clip_rings(points: np.ndarray, offsets: np.ndarray, low: np.ndarray, high: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Every ring cut by a strip of its own; rings of which nothing is left are empty."""
    for bounds, sign in ((low, 1.0), (high, -1.0)):
        count = offsets[1:] - offsets[:-1]
        ring = np.repeat(np.arange(len(count)), count)
        v = (points[:, axis] - bounds[ring]) * sign
        inside = v >= 0
        within = np.bincount(ring, inside, len(count))
        whole = (within == count) & (count >= 4)
        at, of = segments(offsets)
        used = (count >= 4)[of]
        at, of = at[used], of[used]
        a, b, va, vb = points[at], points[at + 1], v[at], v[at + 1]
        cross = inside[at] != inside[at + 1]
        t = np.divide(va, va - vb, out=np.zeros_like(va), where=cross)
        cut = a + (b - a) * t[:, None]
        cut[cross, axis] = bounds[of][cross]
        pieces = np.empty((2 * len(at), 2))
        pieces[0::2], pieces[1::2] = a, cut
        keep = np.empty(2 * len(at), dtype=bool)
        keep[0::2], keep[1::2] = inside[at], cross
        made, of = pieces[keep], np.repeat(of, 2)[keep]
        number = np.bincount(of, minlength=len(count))
        first = np.cumsum(number) - number
        some = number > 0
        open_ = np.zeros(len(count), dtype=bool)
        open_[some] = (made[first[some]] != made[(first + number - 1)[some]]).any(axis=1)
        open_ |= whole
        offsets = offsets_of(number + open_)
        points = np.empty((offsets[-1], 2))
        points[offsets[:-1][of] + np.arange(len(of)) - first[of]] = made
        points[offsets[1:][open_] - 1] = made[first[open_]]
    left = np.flatnonzero(offsets[1:] - offsets[:-1] >= 4)
    at, _ = taken(offsets, left)
    count = np.zeros(len(offsets) - 1, dtype=np.int64)
    count[left] = (offsets[1:] - offsets[:-1])[left]
    return points[at], offsets_of(count)


def _instances(points: np.ndarray, offsets: np.ndarray, first_ring: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rings of ``owner`` items (item k has the rings first_ring[k]:first_ring[k + 1]), copied for each: points, offsets, and whose each ring is."""
    which, rank = repeated((first_ring[1:] - first_ring[:-1])[owner])
    at, made = taken(offsets, first_ring[:-1][owner][which] + rank)
    return points[at], made, which


def slice_polygons(points: np.ndarray, offsets: np.ndarray, first_ring: np.ndarray, zoom: int, buffer: np.ndarray, extents: tuple[int, int, int, int] | None = None):
    """(polygon, column, row, number of rings, filled) of every tile that the buffered polygons meet, the points and offsets of all rings.

    Polygon k has the closed rings first_ring[k]:first_ring[k + 1], the outer one first.
    """
    n = 1 << zoom
    p = points * n
    b = buffer / 256.0
    x_low, y_low, x_high, y_high = extents or (0, 0, n, n)
    outer_at, outer = taken(offsets, first_ring[:-1])
    low, high = np.minimum.reduceat(p[outer_at], outer[:-1]), np.maximum.reduceat(p[outer_at], outer[:-1])
    top = np.maximum(np.maximum(0, np.floor(low[:, 1] - b).astype(np.int64)), y_low)
    bottom = np.minimum(np.minimum(n - 1, np.floor(high[:, 1] + b).astype(np.int64)), y_high - 1)
    first = np.floor(low[:, 0] - b).astype(np.int64)
    polygon, rank = repeated(np.where(bottom < top, 0, np.floor(high[:, 0] + b).astype(np.int64) - first + 1))
    column = first[polygon] + rank
    fits = (column % n >= x_low) & (column % n < x_high)
    polygon, column = polygon[fits], column[fits]
    # strips of one column each
    own_b = b[polygon]
    points_, made, strip = _instances(p, offsets, first_ring, polygon)
    points_, made = clip_rings(points_, made, (column - own_b)[strip], (column + 1 + own_b)[strip], 0)
    left = np.flatnonzero(made[1:] > made[:-1])
    at, made = taken(made, left)
    points_, strip = points_[at], strip[left]
    rings = offsets_of(np.bincount(strip, minlength=len(polygon)))
    at, ring = segments(made)
    of = strip[ring]
    x0, x1, y0, y1 = points_[at, 0], points_[at + 1, 0], points_[at, 1], points_[at + 1, 1]
    real = (x0 != x1) | ((x0 > column[of] - own_b[of]) & (x0 < column[of] + 1 + own_b[of]))
    rows = np.where(rings[1:] > rings[:-1], bottom[polygon] - top[polygon] + 1, 0)
    base = offsets_of(rows + 1)
    change = np.zeros(base[-1] + 1, dtype=np.int64)
    clip = lambda v: np.clip(v - top[polygon][of[real]], 0, rows[of[real]])
    np.add.at(change, base[of[real]] + clip(np.floor(np.minimum(y0, y1)[real] - own_b[of[real]]).astype(np.int64)), 1)
    np.add.at(change, base[of[real]] + clip(np.floor(np.maximum(y0, y1)[real] + own_b[of[real]]).astype(np.int64) + 1), -1)
    touched = np.cumsum(change) > 0
    of_row, rank = repeated(rows)
    crossed = touched[base[of_row] + rank]
    row = top[polygon][of_row] + rank
    # rows that an edge meets
    cut_strip, cut_row = of_row[crossed], row[crossed]
    q, q_offsets, item = _instances(points_, made, rings, cut_strip)
    q_b = own_b[cut_strip][item]
    q, q_offsets = clip_rings(q, q_offsets, cut_row[item] - q_b, cut_row[item] + 1 + q_b, 1)
    some = np.flatnonzero((q_offsets[1:] > q_offsets[:-1]) & (np.abs(signed_areas(q, q_offsets)) > 1e-12)) if len(q) else np.zeros(0, dtype=np.int64)
    at, q_offsets = taken(q_offsets, some)
    q, item = q[at], item[some]
    corner = np.stack([column[cut_strip], cut_row], axis=1)
    q = (q - np.repeat(corner[item], q_offsets[1:] - q_offsets[:-1], axis=0)) * 256
    number = np.bincount(item, minlength=len(cut_strip))
    kept = number > 0
    # rows that none meets are all in or all out until the next edge
    free = ~crossed
    opens = free.copy()
    opens[1:] &= ~(free[:-1] & (of_row[1:] == of_row[:-1]))
    head = np.flatnonzero(opens)
    inside = _inside(points_, made, rings, of_row[head], column[of_row[head]] + 0.5, row[head] + 0.5)
    run = np.cumsum(opens) - 1
    full = np.flatnonzero(free & inside[np.maximum(run, 0)]) if len(head) else np.zeros(0, dtype=np.int64)
    full_strip = of_row[full]
    squares = np.array([[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0], [-1.0, -1.0]])
    reach = buffer[polygon[full_strip]][:, None, None]
    square = np.where(squares < 0, -reach, 256 + reach).reshape(-1, 2)
    owners = np.concatenate([cut_strip[kept], full_strip])
    return (
        polygon[owners], column[owners] % n, np.concatenate([cut_row[kept], row[full]]), np.concatenate([number[kept], np.ones(len(full), dtype=np.int64)]),
        np.concatenate([np.zeros(int(kept.sum()), dtype=bool), np.ones(len(full), dtype=bool)]), np.concatenate([q, square]), np.concatenate([q_offsets, q_offsets[-1] + 5 * np.arange(1, len(full) + 1)]),
    )


def _inside(points: np.ndarray, offsets: np.ndarray, first_ring: np.ndarray, item: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether places are inside the rings of their items."""
    at, ring = segments(offsets)
    seg_offsets = np.searchsorted(ring, first_ring)
    out = np.zeros(len(item), dtype=bool)
    for some in _chunks((seg_offsets[1:] - seg_offsets[:-1])[item]):
        which, rank = repeated((seg_offsets[1:] - seg_offsets[:-1])[item[some]])
        k = at[seg_offsets[:-1][item[some]][which] + rank]
        p, q, px, py = points[k], points[k + 1], x[some][which], y[some][which]
        cross = (p[:, 1] > py) != (q[:, 1] > py)
        p, q, px, py, which = p[cross], q[cross], px[cross], py[cross], which[cross]
        hit = (q[:, 0] - p[:, 0]) * (py - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0] > px
        out[some] = np.bincount(which, hit, len(x[some])) % 2 == 1
    return out


def _chunks(weights: np.ndarray):
    """Slices of consecutive items of about ``PAIRS`` together."""
    if not len(weights):
        return
    part = (np.cumsum(weights) - weights) // PAIRS
    bounds = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(weights)]])
    for a, z in zip(bounds.tolist(), bounds[1:].tolist()):
        yield slice(a, z)


def _nodes(points: np.ndarray, group: np.ndarray, grid: float) -> np.ndarray:
    """A number for each place on the grid of each group."""
    k = np.rint(points / grid).astype(np.int64)
    if not len(k):
        return np.zeros(0, dtype=np.int64)
    k -= k.min(axis=0)
    width, height = (k.max(axis=0) + 1).tolist()
    if (int(group.max()) + 1) * width * height < 1 << 62:
        return np.unique((group * width + k[:, 0]) * height + k[:, 1], return_inverse=True)[1]
    return np.unique(np.column_stack([group, k]), axis=0, return_inverse=True)[1].ravel()


def _split_at_nodes(points: np.ndarray, offsets: np.ndarray, group: np.ndarray, grid: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = offsets[1:] - offsets[:-1]
    node = _nodes(points, np.repeat(group, count), grid)
    at, line = segments(offsets)
    moves = node[at] != node[at + 1]
    at, line = at[moves], line[moves]
    if not len(at):
        return points[:0], np.zeros(1, dtype=np.int64), group[:0]
    # the point before is the end of the segment before; points that stay on their node are passed over
    first = np.concatenate([[True], line[1:] != line[:-1]])
    start, end = np.where(first, offsets[:-1][line], np.concatenate([[0], at[:-1] + 1])), at + 1
    a, b = np.minimum(node[start], node[end]), np.maximum(node[start], node[end])
    fresh = np.zeros(len(at), dtype=bool)
    fresh[np.unique(a * (int(node.max()) + 1) + b, return_index=True)[1]] = True
    opens = first | np.concatenate([[True], ~fresh[:-1]])
    start, end, opens, line = start[fresh], end[fresh], opens[fresh], line[fresh]
    closes = np.concatenate([opens[1:], [True]])
    uses = np.bincount(node[end], np.where(closes, 2, 1), int(node.max()) + 1) + np.bincount(node[start[opens]], minlength=int(node.max()) + 1) * 2
    opens[1:] |= uses[node[end[:-1]]] > 1
    made, made_offsets = chained(points[start], points[end], opens)
    return made, made_offsets, group[line[opens]]


def _merge_through(points: np.ndarray, offsets: np.ndarray, group: np.ndarray, grid: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join the two lines of every node that has just two ends."""
    n = len(group)
    if not n:
        return points, offsets, group
    ends = np.stack([offsets[:-1], offsets[1:] - 1], axis=1).ravel()
    node = _nodes(points[ends], np.repeat(group, 2), grid)
    order = np.argsort(node, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))
    twice = heads[np.diff(np.append(heads, len(order))) == 2]
    x, y = order[twice], order[twice + 1]
    apart = x // 2 != y // 2
    x, y = x[apart], y[apart]
    if not len(x):
        return points, offsets, group
    last_first = np.argsort(-x)  # nodes are visited from the last one met to the first
    now = list(range(n))
    tips = node.reshape(-1, 2).tolist()
    made: dict[int, list[tuple[int, bool, bool, bool]]] = {}  # line, turned, without its first point, without its last

    def root(k: int) -> int:
        while now[k] != k:
            now[k] = now[now[k]]
            k = now[k]
        return k

    gone = np.zeros(n, dtype=bool)
    for i, j, here in zip((x // 2)[last_first].tolist(), (y // 2)[last_first].tolist(), node[x][last_first].tolist()):
        i, j = root(i), root(j)
        if i == j:
            continue
        a, b = min(i, j), max(i, j)
        p, q = (made.pop(k) if k >= n else [(k, False, False, False)] for k in (a, b))
        (p0, p1), (q0, q1) = tips[a], tips[b]
        if p1 != here:
            p, p0 = [(k, not r, s, e) for k, r, s, e in reversed(p)], p1
        if q0 != here:
            q, q1 = [(k, not r, s, e) for k, r, s, e in reversed(q)], q0
        new = len(now)
        now.append(new)
        now[a] = now[b] = new
        tips.append([p0, q1])
        k, r, s, e = q[0]  # the point where they meet is the first line's
        made[new] = [*p, (k, r, s or not r, e or r), *q[1:]]
    for chain in made.values():
        gone[[link[0] for link in chain]] = True
    alone = np.flatnonzero(~gone)
    sizes = np.concatenate([np.ones(len(alone), dtype=np.int64), [len(c) for c in made.values()]]).astype(np.int64)
    links = np.zeros((len(alone) + sum(map(len, made.values())), 4), dtype=np.int64)
    links[: len(alone), 0] = alone
    if made:
        links[len(alone) :] = [link for c in made.values() for link in c]
    link_offsets = offsets_of(sizes)
    # groups stay together, in each the lines joined come last
    of = group[links[link_offsets[:-1], 0]]
    order = np.argsort(of, kind="stable")
    links, sizes = links[taken(link_offsets, order)[0]], sizes[order]
    starts, stops = offsets[:-1][links[:, 0]] + links[:, 2], offsets[1:][links[:, 0]] - links[:, 3]
    which, rank = repeated(stops - starts)
    at = np.where(links[which, 1] == 1, stops[which] - 1 - rank, starts[which] + rank)
    made_offsets = offsets_of(np.add.reduceat(stops - starts, np.cumsum(sizes) - sizes))
    return points[at], made_offsets, of[order]


def merge_lines(points: np.ndarray, offsets: np.ndarray, group: np.ndarray, min_length: np.ndarray, tolerance: float = -1.0, grid: float = 1 / 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged lines of every group and their groups, in ascending order; ``group`` ascends, ``min_length`` is told by group."""
    made = _merge_through(*_split_at_nodes(points, offsets, group, grid), grid)
    if tolerance >= 0:
        slim = douglas_peucker(made[0], made[1], tolerance)
        made = _merge_through(*_split_at_nodes(*slim, made[2], grid), grid)
    points, offsets, group = made
    left = np.flatnonzero(lengths(points, offsets) >= min_length[group])
    at, offsets = taken(offsets, left)
    return points[at], offsets, group[left]


def unions(polygons: list[g.Polygon], cluster: np.ndarray, grid: float = 1e-6) -> list[list[g.Polygon]]:
    """``geometry.union`` of the polygons of each cluster; ``cluster`` ascends from 0 without gaps."""
    rings = [(c, r) for c, polygon in zip(cluster.tolist(), polygons) for r in g.oriented([g.closed(r) for r in polygon])]
    flat = np.round(np.concatenate([r for _, r in rings]) / grid) * grid
    at, ring = segments(offsets_of(np.array([len(r) for _, r in rings])))
    owner = np.array([c for c, _ in rings])[ring]
    seg = np.hstack([flat[at], flat[at + 1]])
    real = (seg[:, :2] != seg[:, 2:]).any(axis=1)
    seg, owner = seg[real], owner[real]
    clusters = int(cluster[-1]) + 1
    seg_offsets = np.searchsorted(owner, np.arange(clusters + 1))
    pieces, of = _split(seg, owner, seg_offsets, grid)
    swap = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    pieces[swap] = pieces[swap][:, [2, 3, 0, 1]]
    order = np.lexsort((pieces[:, 3], pieces[:, 2], pieces[:, 1], pieces[:, 0], of))
    pieces, of = pieces[order], of[order]
    new = np.ones(len(pieces), dtype=bool)
    new[1:] = (pieces[1:] != pieces[:-1]).any(axis=1) | (of[1:] != of[:-1])
    new &= (pieces[:, :2] != pieces[:, 2:]).any(axis=1)
    pieces, of = pieces[new], of[new]
    middle, d = (pieces[:, :2] + pieces[:, 2:]) / 2, pieces[:, 2:] - pieces[:, :2]
    normal = np.stack([-d[:, 1], d[:, 0]], axis=1) / np.hypot(d[:, 0], d[:, 1])[:, None] * grid * 0.25
    left, right = _winding(middle + normal, of, seg, seg_offsets) != 0, _winding(middle - normal, of, seg, seg_offsets) != 0
    ahead, back = np.flatnonzero(left & ~right), np.flatnonzero(right & ~left)
    kept, of = np.concatenate([pieces[ahead], pieces[back][:, [2, 3, 0, 1]]]), np.concatenate([of[ahead], of[back]])
    order = np.argsort(of, kind="stable")
    kept, bounds = kept[order], np.searchsorted(of[order], np.arange(clusters + 1)).tolist()
    return [g.nest(g._rings(kept[a:z])) for a, z in zip(bounds, bounds[1:])]


def _split(seg: np.ndarray, owner: np.ndarray, seg_offsets: np.ndarray, grid: float) -> tuple[np.ndarray, np.ndarray]:
    """The segments of each cluster split where they meet, and their clusters."""
    lo, hi = np.minimum(seg[:, :2], seg[:, 2:]), np.maximum(seg[:, :2], seg[:, 2:])
    count = (seg_offsets[1:] - seg_offsets[:-1])[owner]
    mine, places = [], []
    for some in _chunks(count):
        which, rank = repeated(count[some])
        k, j = which + some.start, seg_offsets[:-1][owner[some]][which] + rank
        near = (k != j) & (lo[j] <= hi[k] + grid).all(axis=1) & (hi[j] >= lo[k] - grid).all(axis=1)
        k, j = k[near], j[near]
        a, d = seg[k, :2], seg[k, 2:] - seg[k, :2]
        c, e = seg[j, :2], seg[j, 2:] - seg[j, :2]
        cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        ac = c - a
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (ac[:, 0] * e[:, 1] - ac[:, 1] * e[:, 0]) / cross
            u = (ac[:, 0] * d[:, 1] - ac[:, 1] * d[:, 0]) / cross
        ok = (cross != 0) & (t > 0) & (t < 1) & (u >= -1e-12) & (u <= 1 + 1e-12)
        mine.append(k[ok])
        places.append(a[ok] + d[ok] * t[ok][:, None])
        size = (d**2).sum(axis=1)
        for p in (c, c + e):  # ends of others that lie on this edge
            v = ((p - a) * d).sum(axis=1) / size
            on = (v > 0) & (v < 1) & (np.abs(d[:, 0] * (p[:, 1] - a[:, 1]) - d[:, 1] * (p[:, 0] - a[:, 0])) <= grid * np.sqrt(size))
            mine.append(k[on])
            places.append(p[on])
    every = np.arange(len(seg))
    mine, places = np.concatenate([every, *mine, every]), np.concatenate([seg[:, :2], *places, seg[:, 2:]])
    along = ((places - seg[mine, :2]) * (seg[mine, 2:] - seg[mine, :2])).sum(axis=1)
    order = np.lexsort((along, mine))
    mine, places = mine[order], np.round(places[order] / grid) * grid + 0.0
    follows = mine[1:] == mine[:-1]
    return np.hstack([places[:-1], places[1:]])[follows], owner[mine[1:]][follows]


def _winding(points: np.ndarray, of: np.ndarray, seg: np.ndarray, seg_offsets: np.ndarray) -> np.ndarray:
    """The winding number of the edges of its cluster around each point."""
    out = np.zeros(len(points), dtype=np.int64)
    count = (seg_offsets[1:] - seg_offsets[:-1])[of]
    for some in _chunks(count):
        which, rank = repeated(count[some])
        s = seg[seg_offsets[:-1][of[some]][which] + rank]
        x, y = points[some][which].T
        up, down = (s[:, 1] <= y) & (s[:, 3] > y), (s[:, 1] > y) & (s[:, 3] <= y)
        side = (s[:, 2] - s[:, 0]) * (y - s[:, 1]) - (x - s[:, 0]) * (s[:, 3] - s[:, 1])
        turn = (up & (side > 0)).astype(np.int64) - (down & (side < 0)).astype(np.int64)
        out[some] = np.bincount(which, turn, len(x) and some.stop - some.start).astype(np.int64)
    return out
