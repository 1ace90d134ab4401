"""Problem 1: points near other points, and regions that contain points.

Method. A bounded sample of the points builds a quadtree on the driver. Each point goes to the leaf that owns its place and,
as a replica, to every other leaf that its search box meets; each region goes to every leaf that its bounding box meets. One
shuffle by leaf follows. Inside a leaf an R-tree is bulk-loaded over the points and probed with the boxes of the owned points
and of the regions; candidates are refined by the exact distance or by the exact polygon test. A pair is reported only in the leaf
that owns its reference point, the place of the smaller key, so no duplicate arises and no ``distinct`` is needed.

Skew and size. Dense areas split into more leaves. Where the bounded sample can no longer tell rows apart, a leaf is divided into a
regular grid, so groups keep their size however large the input is. A cell that is too heavy even at the deepest level is cut into blocks by a hash of the key, and each pair of blocks becomes a group of its own: a group holds at most two blocks, and nothing is dropped.

Defined results for dirty input: rows without a key or a readable place are in no pair; rows that repeat a key count as one
point; regions without readable text contain nothing; points at one place are 0 m apart; an empty table gives an empty result.
Extra columns are ignored. A region's boundary follows the half-open even-odd rule, so regions that share an edge never both
hold a point on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.kernels.quadtree import QuadTree
from terrane.kernels.rtree import PointTree
from terrane.kernels.sphere import haversine, reach
from terrane.kernels.wkt import bounds, in_polygons, polygons
from terrane.streams import over_groups

#: At most so many sampled points reach the driver, whatever the input.
SAMPLE_ROWS = 60_000
#: Rows that a leaf should hold; a leaf over twice as heavy at the deepest level is cut into blocks of this size.
LEAF_ROWS = 20_000
MAX_DEPTH = 20
#: Candidate pairs that one step of the probing should meet.
CANDIDATES = 500_000

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: Group 1 holds the first two numbers; up to two more may follow.
POINT_TEXT = rf"^\s*(?:[sS][rR][iI][dD]\s*=\s*\d+\s*;)?\s*(?i:POINT)\s*(?i:ZM|Z|M)?\s*\(\s*({_NUMBER}\s+{_NUMBER})(?:\s+{_NUMBER}){{0,2}}\s*\)\s*$"


def _within_limits(lon: Column, lat: Column) -> Column:
    return lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)


def places(features: DataFrame, key: str = "feature_id") -> DataFrame:
    """(key, lon, lat): the centroid where it can be read as a point within the limits, else (lon, lat) within them, else no row."""
    # one array of candidates per row, best first: the pattern is matched once, however often its numbers are used
    numbers = F.array(F.split(F.regexp_extract(F.coalesce("centroid", F.lit("")), POINT_TEXT, 1), r"\s+"))
    read = F.transform(numbers, lambda n: F.struct(F.get(n, F.lit(0)).try_cast("double").alias("lon"), F.get(n, F.lit(1)).try_cast("double").alias("lat")))
    candidates = F.concat(read, F.array(F.struct(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))))
    good = F.filter(candidates, lambda p: _within_limits(p["lon"], p["lat"]))
    return features.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.inline(F.slice(good, 1, 1)))


def build_quadtree(
    points: DataFrame, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, max_depth: int = MAX_DEPTH, rows: int | None = None, sampler: Callable[[float], DataFrame] | None = None
) -> QuadTree:
    """The tree over a bounded sample. ``rows`` is an upper estimate of the input's rows; ``sampler`` may give a share of the points more cheaply."""
    rows = points.count() if rows is None else rows
    fraction = min(1.0, sample_rows / max(rows, 1))
    sample = points if fraction == 1 else sampler(fraction) if sampler else points.sample(fraction=fraction, seed=7)
    seen = sample.select("lon", "lat").limit(2 * sample_rows).toPandas()
    return QuadTree(seen["lon"].to_numpy(float), seen["lat"].to_numpy(float), leaf_rows, max_depth, 1 / fraction)


def near_and_within(
    points: DataFrame, regions: DataFrame, metres: float, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, max_depth: int = MAX_DEPTH, rows: int | None = None,
    sampler: Callable[[float], DataFrame] | None = None,
) -> DataFrame:
    """(found_kind, key_a, key_b): pairs of points (key, lon, lat) within ``metres``, and (region, point) pairs of regions (region, wkt)."""
    spark = points.sparkSession
    tree = build_quadtree(points, leaf_rows, sample_rows, max_depth, rows, sampler)
    blocks = np.where(tree.cell_rows > 2 * leaf_rows, np.ceil(tree.cell_rows / leaf_rows), 1).astype(np.int64)
    shared = spark.sparkContext.broadcast((tree, blocks))  # bounded by the sample

    def route_points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quad, cut = shared.value
        for frame in frames:
            key, lon, lat = frame["key"].to_numpy(), frame["lon"].to_numpy(), frame["lat"].to_numpy()
            home, home_cell = quad.home(lon, lat)
            row, *box = reach(lon, lat, metres)
            at, leaf, cell = quad.touched(*box)
            row = row[at]
            if len(box[0]) > len(key):  # boxes over the antimeridian come twice and may meet a cell twice
                row, leaf, cell = np.unique(np.stack([row, leaf, cell], axis=1), axis=0).T
            block = np.array(pd.util.hash_array(key[row].astype(np.int64)) % cut[leaf].astype(np.uint64), dtype=np.int64)
            n = cut[leaf]
            rep = np.repeat(np.arange(len(row)), n)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame(
                {
                    "leaf": leaf[rep].astype(np.int32), "cell": cell[rep], "low": np.minimum(block[rep], other).astype(np.int32), "high": np.maximum(block[rep], other).astype(np.int32),
                    "key": key[row][rep], "lon": lon[row][rep], "lat": lat[row][rep], "block": block[rep].astype(np.int32), "own": ((home[row] == leaf) & (home_cell[row] == cell))[rep], "wkt": None,
                }
            )

    def route_regions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quad, cut = shared.value
        for frame in frames:
            for region, text in zip(frame["region"], frame["wkt"]):
                box = bounds(polygons(text))
                if box is None or region is None:
                    continue
                _, leaf, cell = quad.touched(*(np.array([v]) for v in box))
                rep = np.repeat(np.arange(len(leaf)), cut[leaf])
                part = np.concatenate([np.arange(cut[k]) for k in leaf]).astype(np.int32)
                yield pd.DataFrame({"leaf": leaf[rep].astype(np.int32), "cell": cell[rep], "low": part, "high": part, "key": region, "lon": 0.0, "lat": 0.0, "block": -1, "own": False, "wkt": text})

    schema = "leaf int, cell bigint, low int, high int, key bigint, lon double, lat double, block int, own boolean, wkt string"
    routed = points.select("key", "lon", "lat").mapInPandas(route_points, schema).unionByName(regions.select("region", "wkt").mapInPandas(route_regions, schema))

    def probe(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        is_region = group["block"].to_numpy() == -1
        zones = group[is_region].drop_duplicates("key")
        group = group[~is_region].drop_duplicates("key")
        if group.empty:
            return
        key, lon, lat, own, block = (group[c].to_numpy() for c in ("key", "lon", "lat", "own", "block"))
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        index = PointTree(lon, lat)
        mine = np.flatnonzero(own)
        start, step = 0, 256
        while start < len(mine):
            rows = mine[start : start + step]
            start += len(rows)
            at, *box = reach(lon[rows], lat[rows], metres)
            query, hit = index.probe(*box)
            step = int(np.clip(CANDIDATES * len(rows) / max(len(query), 1), 16, 8192))  # dense places are probed in small steps
            left, right = rows[at[query]], hit
            keep = key[left] < key[right]
            if low != high:
                keep &= block[left] != block[right]
            left, right = left[keep], right[keep]
            close = haversine(lon[left], lat[left], lon[right], lat[right]) <= metres
            if close.any():
                found = np.stack([key[left[close]], key[right[close]]], axis=1)
                if len(at) > len(rows):
                    found = np.unique(found, axis=0)
                yield pd.DataFrame({"found_kind": "near", "key_a": found[:, 0], "key_b": found[:, 1]})
        if low == high:
            for region, text in zip(zones["key"], zones["wkt"]):
                parts = polygons(text)
                x0, y0, x1, y1 = bounds(parts)
                _, hit = index.probe(*(np.array([v]) for v in (x0, y0, x1, y1)))
                hit = hit[own[hit]]
                inside = hit[in_polygons(lon[hit], lat[hit], parts)]
                if len(inside):
                    yield pd.DataFrame({"found_kind": "within", "key_a": region, "key_b": key[inside]})

    return over_groups(routed, ["leaf", "cell", "low", "high"], probe, "found_kind string, key_a bigint, key_b bigint")
