import random

import numpy as np
import pytest

import __spark_entry__ as entry
from terrane.kernels.wkt import in_polygons, polygons
from terrane.operators import spatial

DATA = "/root/testdata/sf0.001"
SHAPES = [
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((1 1, 1 9, 9 9, 9 1, 1 1))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((2 2, 8 2, 8 5, 5 5, 5 8, 2 8, 2 2))",
    "POLYGON ((-9 -9, -1 -9, -1 -1, -9 -1, -9 -9), (-6 -6, -3 -6, -3 -3, -6 -3, -6 -6))", "MULTIPOLYGON (((10 0, 12 0, 12 2, 10 2, 10 0)), ((14 0, 16 0, 16 2, 14 2, 14 0)))",
    "POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))", "POLYGON ((-12 4, -8 8, -12 12, -16 8, -12 4))", "POLYGON ((3 3, 3 3, 3 3, 3 3, 3 3))", "POLYGON ((a b))", None, "",
]


def far(x, y, parts):
    if in_polygons(np.array([x]), np.array([y]), parts)[0]:
        return 0.0
    found = []
    for rings in parts:
        for ring in rings:
            for a, b in zip(ring, np.roll(ring, -1, axis=0)):
                along = np.clip(np.dot([x, y] - a, b - a) / (np.dot(b - a, b - a) or 1), 0, 1)
                found.append(float(np.hypot(*(a + along * (b - a) - [x, y]))))
    return min(found)


@pytest.mark.parametrize("heavy,text", [(500_000, False), (7, False), (7, True)])
def test_regions_of_points_match_brute_force(spark, monkeypatch, heavy, text):
    """Rectangles and others, equal ones, edges and corners, repeated and unplaced points, cells cut into blocks, keys beyond 2^53 and text keys."""
    monkeypatch.setattr(spatial, "HEAVY", heavy)
    rng = random.Random(6)
    name = (lambda k: f"k{k:03d}") if text else (lambda k: 2**60 + k)
    kind = "string" if text else "bigint"
    points = [(name(k), rng.uniform(-18, 18), rng.uniform(-12, 14)) for k in range(300)]
    points += [(name(400 + k), float(rng.randint(-18, 18)), float(rng.randint(-12, 14))) for k in range(150)] + [(name(600 + k), 3.0, 3.0) for k in range(40)]
    dirty = [points[0], (name(700), None, 1.0), (name(701), 1.0, float("nan"))]
    areas = [(name(900 - k), w) for k, w in enumerate(SHAPES)]
    df, regions = spark.createDataFrame(points + dirty, f"key {kind}, lon double, lat double"), spark.createDataFrame(areas, f"area {kind}, wkt string")
    read = {a: p for a, w in areas if (p := polygons(w))}
    held = {(k, a) for k, x, y in points for a, p in read.items() if in_polygons(np.array([x]), np.array([y]), p)[0]}
    got = [tuple(r) for r in spatial.containing(df, regions).collect()]
    assert set(got) == held and len(got) == len(held) + sum(k == points[0][0] for k, _ in held)
    first = {}
    for k, a in held:
        first[k] = min(a, first.get(k, a))
    got = [tuple(r) for r in spatial.first_containing(df, regions).collect()]
    assert len(got) == len(first) and dict(got) == first
    near = {}
    for k, x, y in points:
        best = min((round(far(x, y, p), 9), a) for a, p in read.items())
        if best[0] <= 3:
            near[k] = (best[1], round(best[0], 6))
    got = [(r["key"], r["area"], round(r["distance"], 6)) for r in spatial.containing_or_nearest(df, regions, 3.0).collect()]
    assert len(got) == len(near) and {k: v for k, *v in got} == {k: list(v) for k, v in near.items()}


@pytest.mark.parametrize("name", ["join07_point_in_polygon", "join07_only_first", "join09_containing_or_nearest"])
def test_no_pair_of_point_and_region_is_joined(spark, name):
    """The only join is the one with the few heavy cells; texts of rectangles do not meet the points."""
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") == 2
