import time

import numpy as np

from terrane.kernels import batch as b
from terrane.kernels import geometry as g
from terrane.kernels import mvt
from terrane.kernels.lines import merge_lines

RANDOM = np.random.default_rng(7)


def flat(lines):
    return np.concatenate(lines), b.offsets_of(np.array([len(x) for x in lines]))


def lines_of(points, offsets):
    return [points[a:z] for a, z in zip(offsets, offsets[1:])]


def same(ours, theirs):
    return len(ours) == len(theirs) and all(x.shape == y.shape and np.allclose(x, y, atol=1e-9) for x, y in zip(ours, theirs))


def network(n):
    """Lines between few places, so that they meet, repeat, cross and close."""
    return [RANDOM.integers(0, 5, (RANDOM.integers(1, 6), 2)) * 8.0 + RANDOM.normal(0, 0.01, 2) for _ in range(n)]


def test_lines_of_many_groups_merge_at_once():
    """The same lines as group by group, and the cost of a group is not that of a call."""
    groups = [network(RANDOM.integers(1, 12)) for _ in range(3000)]
    began = time.process_time()
    theirs = [merge_lines(lines, min_length=0.5, tolerance=0.2) for lines in groups]
    alone, began = time.process_time() - began, time.process_time()
    points, offsets, of = b.merge_lines(*flat([x for lines in groups for x in lines]), np.repeat(np.arange(3000), [len(x) for x in groups]), np.full(3000, 0.5), 0.2)
    assert time.process_time() - began < alone / 2
    made = lines_of(points, offsets)
    bounds = np.searchsorted(of, np.arange(3001))
    assert all(same(made[a:z], want) for a, z, want in zip(bounds, bounds[1:], theirs))


def test_shapes_of_a_batch_are_cut_as_each_alone():
    lines = [RANDOM.random((RANDOM.integers(2, 9), 2)) * 1.2 - 0.1 for _ in range(60)]
    polygons = [[g.closed(RANDOM.random((RANDOM.integers(3, 9), 2)))] for _ in range(40)] + [[g.fill_ring(0) / 300, g.fill_ring(0)[::-1] / 900 + 0.3]]
    for zoom, buffer, extents in ((3, 4.0, None), (5, 8.0, None), (5, 0.0, (4, 6, 20, 17))):
        points, offsets = flat(lines)
        line, x, y, number, out, parts = b.slice_lines(points, offsets, zoom, np.full(len(lines), buffer), extents)
        ends = np.cumsum(number)
        ours = {(k, c, r): lines_of(out, parts[e - n : e + 1]) for k, c, r, n, e in zip(line, x, y, number, ends)}
        theirs = {(k, c, r): made for k, one in enumerate(lines) for c, r, made, _ in g.slice_to_tiles("line", one, zoom, buffer, extents) if 0 <= one.min() and one.max() < 1}
        assert theirs.keys() <= ours.keys() and all(same(ours[k], theirs[k]) for k in theirs)
        points, offsets = flat([r for p in polygons for r in p])
        which, x, y, number, filled, out, parts = b.slice_polygons(points, offsets, b.offsets_of(np.array([len(p) for p in polygons])), zoom, np.full(len(polygons), buffer), extents)
        ends = np.cumsum(number)
        ours = {(k, c, r): (lines_of(out, parts[e - n : e + 1]), f) for k, c, r, n, e, f in zip(which, x, y, number, ends, filled)}
        theirs = {(k, c, r): ([q for p in made for q in p], full) for k, p in enumerate(polygons) for c, r, made, full in g.slice_to_tiles("polygon", p, zoom, buffer, extents)}
        assert ours.keys() == theirs.keys() and all(same(ours[k][0], theirs[k][0]) and ours[k][1] == theirs[k][1] for k in theirs)
        assert any(full for _, full in theirs.values())


def test_clusters_are_united_and_lines_simplified_as_each_alone():
    clusters = [[[g.closed(RANDOM.random((3, 2)) * 50 + RANDOM.random(2) * 20)] for _ in range(RANDOM.integers(2, 5))] for _ in range(60)]
    ours = b.unions([p for c in clusters for p in c], np.repeat(np.arange(60), [len(c) for c in clusters]))
    assert all(same([r for p in a for r in p], [r for p in g.union(c) for r in p]) for a, c in zip(ours, clusters))
    rings = [g.closed(RANDOM.random((RANDOM.integers(1, 20), 2))) for _ in range(50)]
    for ring in (False, True):
        assert same(lines_of(*b.douglas_peucker(*flat(rings), 0.3, ring)), [g.douglas_peucker(r, 0.3, ring) for r in rings])


def test_packed_commands():
    rows = [("point", [[(3.0, 4.0), (5.0, 5.0)]]), ("line", [[(0, 0), (0, 0.01), (9, -300)], [(1, 1), (1, 1)], [(7, 7), (8, 8)]]), ("polygon", [[(0, 0), (4, 0), (4, 4), (0, 0)], [(1, 1), (1.01, 1), (1, 1)]]), ("line", [[(2, 2), (2, 2)]])]
    parts = [np.array(p, dtype=float) for _, shape in rows for p in shape]
    ours = mvt.packed_commands(np.array([mvt.KINDS[k] for k, _ in rows]), *flat(parts), np.repeat(np.arange(4), [len(s) for _, s in rows]))
    assert ours == [mvt._packed(mvt.commands(k, s[0] if k == "point" else s)) for k, s in rows]
