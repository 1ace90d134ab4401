import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.kernels import geometry as g
from terrane.kernels import lines as ln
from terrane.kernels import mvt


def square(x, y, w, h=None):
    h = h or w
    return [g.closed(np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], dtype=float))]


def test_measures():
    ring_with_hole = [square(0, 0, 4)[0], square(1, 1, 2)[0]]
    assert g.area(ring_with_hole) == 12 and g.length(square(0, 0, 4)[0]) == 16
    assert np.allclose(g.centroid(square(2, 3, 4)), (4, 5)) and np.allclose(g.centroid(ring_with_hole), (2, 2))
    assert g.contains(ring_with_hole, 0.5, 2) and not g.contains(ring_with_hole, 2, 2)
    assert g.contains(ring_with_hole, *g.point_on_surface(ring_with_hole))
    u = [g.closed(np.array([[0, 0], [10, 0], [10, 10], [9, 10], [9, 1], [1, 1], [1, 10], [0, 10]], dtype=float))]
    assert g.contains(u, *g.point_on_surface(u)) and g.contains(u, *g.innermost_point(u))
    assert np.allclose(g.innermost_point(square(0, 0, 4), 0.01), (2, 2), atol=0.1)
    assert g.is_convex(square(0, 0, 1)[0]) and not g.is_convex(u[0])
    assert g.centroid_if_convex(u) is None


def test_along_and_part():
    line = np.array([[0, 0], [10, 0], [10, 10]], dtype=float)
    assert np.allclose(g.along(line, 0.25), (5, 0)) and np.allclose(g.along(line, 1), (10, 10))
    assert np.allclose(g.part(line, 0.25, 0.75), [[5, 0], [10, 0], [10, 5]])
    with pytest.raises(ValueError):
        g.along(line, 1.5)


def test_simplifiers():
    line = np.array([[0, 0], [1, 0.1], [2, 0], [3, 5], [4, 0]], dtype=float)
    assert len(g.douglas_peucker(line, 0.5)) == 4 and len(g.douglas_peucker(line, 0)) == 5
    ring = g.closed(np.array([[0, 0], [0.1, 0], [0.1, 0.1], [0, 0.1]]))
    assert len(g.douglas_peucker(ring, 100, ring=True)) >= 4
    assert len(g.visvalingam(line, 0.5)) == 4 and len(g.visvalingam(ring, 100, ring=True)) == 4
    assert (g.visvalingam(line, 100)[[0, -1]] == line[[0, -1]]).all()
    assert len(g.visvalingam(line, 0.5, weight=0.7)) <= 5


def test_smoothing_keeps_ends_and_closure():
    line = np.array([[0, 0], [4, 4], [8, 0]], dtype=float)
    assert g.midpoint_smooth(line).tolist() == [[0, 0], [2, 2], [6, 2], [8, 0]]
    assert g.chaikin(line).tolist() == [[0, 0], [3, 3], [5, 3], [8, 0]]
    ring = g.chaikin(square(0, 0, 4)[0])
    assert (ring[0] == ring[-1]).all() and len(ring) == 9
    assert g.pipeline(g.midpoint_smooth, lambda x: x * 2)(line)[-1].tolist() == [16, 0]
    assert len(g.chaikin(line, 3, least_area=100)) == 3


def test_clip():
    assert [p.tolist() for p in g.clip_line(np.array([[-5, 5], [15, 5]], dtype=float), 0, 0, 10, 10)] == [[[0, 5], [10, 5]]]
    zigzag = np.array([[1, 1], [20, 1], [20, 2], [1, 2]], dtype=float)
    assert len(g.clip_line(zigzag, 0, 0, 10, 10)) == 2
    assert g.area(g.clip_polygon(square(-5, -5, 10), 0, 0, 10, 10)) == 25
    assert g.clip_polygon(square(20, 20, 5), 0, 0, 10, 10) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0.02, 0.98), st.floats(0.02, 0.98)), min_size=3, max_size=8, unique=True), st.integers(0, 4))
def test_tiles_of_a_polygon_add_up(points, zoom):
    """Without a buffer, the pieces on all tiles have the area of the whole."""
    center = np.mean(points, axis=0)
    ring = g.closed(np.array(sorted(points, key=lambda p: np.arctan2(p[1] - center[1], p[0] - center[0]))))
    if abs(g.signed_area(ring)) < 1e-3:
        return
    total = sum(g.area(p) for _, _, parts, _ in g.slice_to_tiles("polygon", [ring], zoom, 0.0) for p in parts)
    assert np.isclose(total / 65536 / 4**zoom, abs(g.signed_area(ring)), rtol=1e-6)


def test_filled_tiles_and_wrapping():
    tiles = g.slice_to_tiles("polygon", square(0.0, 0.0, 1.0), 3, 4.0)
    assert len({(x, y) for x, y, _, _ in tiles}) == 64 and sum(f for _, _, _, f in tiles) > 30
    assert g.is_fill(g.fill_ring(4), 4) and not g.is_fill(square(0, 0, 10)[0])
    assert {x for x, _, _, _ in g.slice_to_tiles("line", np.array([[0.95, 0.5], [1.05, 0.5]]), 3)} == {7, 0}
    assert g.covered_tiles("line", np.array([[0.1, 0.1], [0.9, 0.1]]), 2) == {(x, 0) for x in range(4)}
    assert g.slice_to_tiles("line", np.array([[0.1, 0.1], [0.9, 0.1]]), 2, 0.0, (1, 0, 3, 4))[0][0] == 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=7))
def test_union_and_difference_of_rectangles(rects):
    """Against a raster of unit cells, which is exact for whole rectangles."""
    a = [square(x, y, w, h) for x, y, w, h in rects]
    cells = set(itertools.chain.from_iterable(itertools.product(range(x, x + w), range(y, y + h)) for x, y, w, h in rects))
    made = g.union(a)
    assert np.isclose(sum(g.area(p) for p in made), len(cells))
    hole = square(3, 3, 5)
    left = g.difference(a, [hole])
    assert np.isclose(sum(g.area(p) for p in left), len({c for c in cells if not (3 <= c[0] < 8 and 3 <= c[1] < 8)}))


def test_buffer_and_repair():
    assert 32 + np.pi <= g.area(g.buffered([square(0, 0, 4)], 1)[0]) <= 32 + np.pi + 0.2  # octagons around the corners
    assert np.isclose(g.area(g.buffered([square(0, 0, 4)], -1)[0]), 4)
    assert g.buffered([square(0, 0, 1)], -1) == []
    near = g.buffered(g.buffered([square(0, 0, 2), square(2.5, 0, 2)], 0.5), -0.5)
    assert len(near) == 1
    bow = [g.closed(np.array([[0, 0], [2, 2], [2, 0], [0, 2]], dtype=float))]
    assert sum(g.area(p) for p in g.snapped(bow)) == 2


def test_ring_assembly():
    """Segments in any direction, a ring gap, a hole with an island in it."""
    outer = [np.array([[0, 0], [10, 0], [10, 10]]), np.array([[0, 0], [0, 10], [10, 10 + 1e-12]])]
    made = g.assemble([*outer, square(2, 2, 6)[0], square(4, 4, 1)[0], np.array([[50, 50], [60, 60]])])
    assert sorted(round(g.area(p), 6) for p in made) == [1, 64]
    assert g.assemble([]) == []


def test_line_merging():
    a, b, c = [(0, 0), (1, 0)], [(2, 0), (1, 0)], [(5, 5), (6, 6)]
    merged = ln.merge_lines([a, b, c])
    assert sorted(len(x) for x in merged) == [2, 3]
    assert len(ln.merge_lines([a, b, c], min_length=1.5)) == 1
    assert len(ln.merge_lines([a, a, a[::-1]])) == 1
    star = [[(0, 0), (10, 0)], [(0, 0), (-10, 0.1)], [(0, 0), (0, 1)]]
    assert len(ln.merge_lines(star)) == 3
    assert len(ln.merge_lines(star, stub_min_length=2)) == 1
    assert sorted(round(g.length(x)) for x in ln.merge_lines(star, strokes=True)) == [1, 20]
    loop = [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]
    assert ln.merge_lines(loop, loop_min_length=10) == [] and len(ln.merge_lines(loop)) == 1
    assert len(ln.merge_lines([[(0, 0), (5, 0.01), (10, 0)]], tolerance=0.1)[0]) == 2


ATTR = st.one_of(st.text(max_size=8), st.integers(-(2**40), 2**40), st.booleans(), st.floats(allow_nan=False, allow_infinity=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**40), st.lists(st.tuples(st.integers(-100, 400), st.integers(-100, 400)), min_size=1, max_size=5), st.dictionaries(st.text(min_size=1, max_size=5), ATTR, max_size=4)), min_size=1, max_size=5))
def test_tiles_round_trip(rows):
    features = [{"id": i, "kind": "point", "commands": mvt.commands("point", p), "attrs": a} for i, p, a in rows]
    back = mvt.decode(mvt.compressed(mvt.encode({"x": features, "empty": []})))
    assert list(back) == ["x"] and [(f["id"], f["attrs"]) for f in back["x"]] == [(i, a) for i, _, a in rows]
    assert [mvt.parts_of("point", f["commands"]) for f in back["x"]] == [[(float(x), float(y)) for x, y in p] for _, p, _ in rows]


def test_lines_and_polygons_round_trip():
    line = [np.array([[0, 0], [10, 0], [10, 0], [20.5, 7.25]])]
    assert mvt.parts_of("line", mvt.commands("line", line))[0].tolist() == [[0, 0], [10, 0], [20.5, 7.25]]
    rings = [*square(0, 0, 100), square(20, 20, 30)[0][::-1]]
    back = mvt.parts_of("polygon", mvt.commands("polygon", rings))
    assert len(back) == 1 and len(back[0]) == 2 and g.area(back[0]) == 9100
    assert mvt.commands("line", [np.array([[0, 0], [0.001, 0]])]) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=9))
def test_union_by_clusters_covers_the_same(rects):
    polygons = [[g.closed(np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], dtype=float))] for x, y, w, h in rects]
    parts = g.clusters(polygons)
    assert sum(map(len, parts)) == len(polygons)
    assert abs(sum(map(g.area, g.merged_union(polygons))) - len({(i, j) for x, y, w, h in rects for i in range(x, x + w) for j in range(y, y + h)})) < 1e-6
