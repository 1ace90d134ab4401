import random

import numpy as np
import pytest

from terrane.kernels.quadtree import QuadTree
from terrane.kernels.rtree import PointTree
from terrane.kernels.sphere import haversine, reach
from terrane.kernels.wkt import in_polygons, polygons
from terrane.operators import proximity

FEATURES = "feature_id bigint, lat double, lon double, centroid string, key string, wkt string"


def test_rtree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    for n in (1, 5, 16, 17, 300, 2000):
        x, y = rng.random(n), rng.random(n)
        x[: n // 3] = 0.5  # ties
        tree = PointTree(x, y)
        q = rng.random((20, 2))
        box = (q[:, 0] - 0.1, q[:, 1] - 0.1, q[:, 0] + 0.1, q[:, 1] + 0.1)
        got = sorted(zip(*map(list, tree.probe(*box))))
        want = sorted((k, j) for k in range(20) for j in range(n) if box[0][k] <= x[j] <= box[2][k] and box[1][k] <= y[j] <= box[3][k])
        assert got == want


def test_quadtree_owns_every_point_once_and_touches_cover_it():
    rng = np.random.default_rng(2)
    lon, lat = np.concatenate([rng.uniform(-180, 180, 500), np.full(500, 7.5)]), np.concatenate([rng.uniform(-90, 90, 500), np.full(500, 50.1)])
    tree = QuadTree(lon, lat, 20, 12)
    fine = QuadTree(lon[::50], lat[::50], 5, 12, weight=50.0)
    assert tree.counts.sum() == 1000 and not tree.levels.any() and fine.levels.max() > 0 and fine.cell_rows[fine.levels < 3].max() <= 1000
    for t in (tree, fine):
        leaf, cell = t.home(lon, lat)
        row, leaves, cells = t.touched(lon - 1e-9, lat - 1e-9, lon + 1e-9, lat + 1e-9)
        met = set(zip(row.tolist(), leaves.tolist(), cells.tolist()))
        assert leaf.min() >= 0 and all((k, a, b) in met for k, (a, b) in enumerate(zip(leaf.tolist(), cell.tolist())))


@pytest.mark.parametrize("lon,lat", [(0.0, 0.0), (179.9999, 10.0), (-180.0, -60.0), (12.0, 89.9999), (5.0, -90.0), (0.0, 85.0)])
def test_reach_covers_the_distance(lon, lat):
    rng = np.random.default_rng(3)
    r = 25 / 111_000 * 1.5
    lons = (lon + rng.uniform(-r, r, 3000) / max(np.cos(np.radians(lat)), 1e-6) + 180) % 360 - 180
    lats = np.clip(lat + rng.uniform(-r, r, 3000), -90, 90)
    close = haversine(lon, lat, lons, lats) <= 25
    _, x0, y0, x1, y1 = reach(np.array([lon]), np.array([lat]), 25.0)
    inside = np.zeros(3000, dtype=bool)
    for a, b, c, d in zip(x0, y0, x1, y1):
        inside |= (lons >= a) & (lons <= c) & (lats >= b) & (lats <= d)
    assert close.any() and (inside | ~close).all()


def test_polygon_text():
    parts = polygons("MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4)), ((20 0, 30 0, 30 10, 20 0)))")
    assert [len(p) for p in parts] == [2, 1]
    x, y = np.array([5.0, 1.0, 29.0, 21.0, 50.0]), np.array([5.0, 1.0, 1.0, 9.0, 1.0])
    assert in_polygons(x, y, parts).tolist() == [False, True, True, False, False]
    assert polygons(None) == polygons("") == polygons("POINT (1 2)") == polygons("POLYGON ((a b))") == []


def test_places(spark):
    rows = [
        (1, 1.0, 2.0, "POINT (3 4)"), (2, 1.0, 2.0, " point( 3.5\t-4e0 ) "), (3, 1.0, 2.0, "SRID=4326;POINT Z (3 4 9)"), (4, 1.0, 2.0, "POINT (200 4)"), (5, 1.0, 2.0, "POINT EMPTY"), (6, 1.0, 2.0, "POINT (3"),
        (7, float("nan"), 2.0, None), (8, 91.0, 2.0, ""), (9, None, 2.0, "POINT (NaN NaN)"), (None, 1.0, 2.0, None), (10, -90.0, 180.0, None), (11, 1.0, 2.0, "POINT (1 2) x"), (12, 1.0, 2.0, "x" * 100_000),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], FEATURES)
    got = {r["key"]: (r["lon"], r["lat"]) for r in proximity.places(df).collect()}
    assert got == {1: (3, 4), 2: (3.5, -4), 3: (3, 4), 4: (2, 1), 5: (2, 1), 6: (2, 1), 10: (180, -90), 11: (2, 1), 12: (2, 1)}


@pytest.mark.parametrize("leaf_rows,max_depth,sample_rows", [(10_000, 20, 60_000), (15, 20, 60_000), (4, 3, 60_000), (4, 14, 12), (2, 6, 12)])
def test_pairs_match_brute_force(spark, leaf_rows, max_depth, sample_rows):
    rng = random.Random(4)
    points = [(k, 16.37 + rng.gauss(0, 4e-4), 48.2 + rng.gauss(0, 3e-4)) for k in range(150)]  # a third and more in one town
    points += [(200 + k, 180 - rng.random() * 2e-4 if k % 2 else -180 + rng.random() * 2e-4, 10.0) for k in range(20)]
    points += [(300 + k, rng.uniform(-180, 180), 89.9999) for k in range(10)] + [(400, 0.0, 90.0), (401, 77.0, 90.0), (402, -180.0, 0.0), (403, 180.0, 0.0)]
    points += [(500 + k, rng.uniform(-180, 180), rng.uniform(-90, 90)) for k in range(60)] + [points[0], points[0]] + [(600, *points[1][1:])]
    zones = [(1, "POLYGON ((16 48, 17 48, 17 49, 16 49, 16 48), (16.37 48.2, 16.371 48.2, 16.371 48.201, 16.37 48.201, 16.37 48.2))"), (2, "POLYGON ((-180 -90, 180 -90, 180 0, -180 0, -180 -90))"), (3, None), (4, "junk"), (None, "POLYGON ((0 0, 1 0, 1 1, 0 0))")]
    one = {k: (x, y) for k, x, y in points}
    keys = sorted(one)
    want = {("near", a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if haversine(*one[a], *one[b]) <= 25}
    x, y = np.array([one[k][0] for k in keys]), np.array([one[k][1] for k in keys])
    for zone, text in zones[:2]:
        want |= {("within", zone, k) for k, hit in zip(keys, in_polygons(x, y, polygons(text))) if hit}
    df, regions = spark.createDataFrame(points, "key bigint, lon double, lat double"), spark.createDataFrame(zones, "region bigint, wkt string")
    got = [tuple(r) for r in proximity.near_and_within(df, regions, 25.0, leaf_rows=leaf_rows, max_depth=max_depth, sample_rows=sample_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "key bigint, lon double, lat double")
    regions = spark.createDataFrame([], "region bigint, wkt string")
    assert proximity.near_and_within(none, regions, 25.0).count() == 0
    assert proximity.near_and_within(none, spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "region bigint, wkt string"), 25.0).count() == 0
