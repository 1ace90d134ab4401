import random

import duckdb
import pytest

import __spark_entry__ as entry
from terrane.operators import clusters


def brute(points, distance):
    up = {k: k for k, _, _ in points}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    met = set()
    for k, x, y in points:
        for m, u, v in points:
            if k < m and (x - u) ** 2 + (y - v) ** 2 <= distance * distance:
                met |= {k, m}
                a, b = root(k), root(m)
                up[max(a, b)] = min(a, b)
    return {(k, root(k)) for k in met}


@pytest.mark.parametrize("few", [clusters.FEW, 0])
def test_components_match_brute_force(spark, monkeypatch, few):
    """Sparse, middling and dense places, chains over the borders of tiles, gaps just below and above the distance, dirty rows."""
    monkeypatch.setattr(clusters, "FEW", few)
    rng = random.Random(5)
    points = [(k, rng.uniform(-60, -20), rng.uniform(-30, 10)) for k in range(400)]
    points += [(1000 + k, rng.uniform(0, 12), rng.uniform(-6, 6)) for k in range(250)]
    points += [(2000 + k, 40 + rng.gauss(0, 0.3), 40 + rng.gauss(0, 0.3)) for k in range(150)]
    points += [(3000 + k, 60 + 0.79 * k, 20 - 0.01 * k) for k in range(40)] + [(3100 + k, 60 + 0.81 * k, 60.0) for k in range(40)]
    points += [(3200 + k, 100 + rng.choice([0, 0.1, 0.9, 1.6]) + rng.uniform(-0.1, 0.1), -50 + rng.choice([0, 0.72]) + rng.uniform(-0.1, 0.1)) for k in range(30)]
    dirty = [points[0], points[0], (5000, 150.0, 0.0), (5000, 150.0, 0.0), (None, -40.0, 0.0), (5001, None, 0.0), (5002, float("nan"), 0.0)]
    want = brute(points, 0.8)
    got = [tuple(r) for r in clusters.close_components(spark.createDataFrame(points + dirty, "key bigint, lon double, lat double"), 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len({c for _, c in want}) > 20 and len(want) < len(points)


def test_one_place_with_very_many_points(spark, tmp_path):
    """Five thousand million pairs, if pairs were made; ids that lie 6,120,000 apart have the same place."""
    duckdb.sql(f"COPY (SELECT range * 6120000 + 7 AS event_id, 'purchase' AS event_type FROM range(100000)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("agg21_components_all_events", "agg21_components"):
        found = entry.queries()[name](spark, str(tmp_path))
        assert [tuple(r) for r in found.groupBy("component").count().collect()] == [(7, 100000)]


def test_no_points(spark):
    assert clusters.close_components(spark.createDataFrame([], "key bigint, lon double, lat double"), 0.8).count() == 0
