"""Planar point, box and polygon joins: candidates by grid cells as an equi join, then the exact test.

For distances the cell size is the search distance, so a point meets at most nine cells; no side is broadcast or crossed. Points and
regions meet in a sort by cell and are tested in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.kernels.wkt import bounds, in_polygons, polygons


#: Grid cells with more points than this are cut into blocks of about so many.
HEAVY = 500_000


def _cell(v, size: float):
    return F.floor(v / size).cast("bigint")


def points_within(left: DataFrame, right: DataFrame, distance: float, square: bool = False) -> DataFrame:
    """All columns of ``left`` (x, y) and ``right`` (lon, lat) for pairs at most ``distance`` apart, or within its square."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = left.withColumn("_o", F.explode(around)).withColumn("_cx", _cell(F.col("x"), distance) + F.col("_o.i")).withColumn("_cy", _cell(F.col("y"), distance) + F.col("_o.j")).drop("_o")
    cells = right.withColumn("_cx", _cell(F.col("lon"), distance)).withColumn("_cy", _cell(F.col("lat"), distance))
    joined = near.join(cells, ["_cx", "_cy"])
    if square:
        test = (F.abs(F.col("lon") - F.col("x")) <= distance) & (F.abs(F.col("lat") - F.col("y")) <= distance)
    else:
        test = F.pow(F.col("lon") - F.col("x"), F.lit(2)) + F.pow(F.col("lat") - F.col("y"), F.lit(2)) <= distance * distance
    return joined.filter(test).drop("_cx", "_cy")


def nearest_point(left: DataFrame, right: DataFrame, distance: float, key: str, item: str) -> DataFrame:
    """(key, item): the nearest point inside the square of that half width; ties go to the smaller item."""
    d2 = F.pow(F.col("lon") - F.col("x"), F.lit(2)) + F.pow(F.col("lat") - F.col("y"), F.lit(2))
    return points_within(left, right, distance, square=True).groupBy(key).agg(F.min_by(item, F.struct(F.round(d2, 9), F.col(item))).alias(item))


def _is_box(parts: list) -> bool:
    """Whether polygons are one rectangle along the axes."""
    if len(parts) != 1 or len(parts[0]) != 1:
        return False
    ring = parts[0][0]
    if len(ring) != 5 or (ring[0] != ring[-1]).any():
        return False
    steps = np.diff(ring, axis=0) != 0
    return bool((steps.sum(axis=1) == 1).all() and (steps[:-1, 0] != steps[1:, 0]).all())


def _boxed(regions: DataFrame) -> DataFrame:
    """The readable regions (area, wkt) with their bounds, and whether they are nothing but these."""

    def boxes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = ((a, w, polygons(w)) for a, w in zip(frame["area"], frame["wkt"]))
            rows = [(a, w, *b, _is_box(parts)) for a, w, parts in read if (b := bounds(parts)) is not None]
            yield pd.DataFrame(rows, columns=["area", "wkt", "minx", "miny", "maxx", "maxy", "box"])

    kind = regions.schema["area"].dataType.simpleString()
    return regions.select("area", "wkt").mapInPandas(boxes, f"area {kind}, wkt string, minx double, miny double, maxx double, maxy double, box boolean")


def _celled(boxed: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    across = F.sequence(_cell(F.col("minx") - margin, size), _cell(F.col("maxx") + margin, size))
    down = F.sequence(_cell(F.col("miny") - margin, size), _cell(F.col("maxy") + margin, size))
    return boxed.withColumn("_cx", F.explode(across)).withColumn("_cy", F.explode(down))


def region_cells(regions: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """The regions (area, wkt) with their boxes, once per grid cell that the box (grown by ``margin``) meets."""
    return _celled(_boxed(regions), size, margin).drop("box")


def _met(points: DataFrame, regions: DataFrame, size: float, margin: float, test: Callable, schema: str) -> DataFrame:
    """What ``test`` finds among the points (key, lon, lat) and the regions (area, wkt) of each grid cell.

    Points and regions meet in one sort by cell: the regions of a cell are held, its points stream past them in batches, so neither pairs nor
    texts of regions are shuffled. Cells of more than ``HEAVY`` points are cut into blocks by the key, and their regions repeated.
    ``test(x, y, box, others)`` gets places, the bounds of the regions in the order of their area keys and the polygons of those that are
    not rectangles, as (position, polygons), and returns (positions of points, positions of regions, further columns).
    """
    key, area = (F.lit(None).cast(df.schema[c].dataType) for df, c in ((points, "key"), (regions, "area")))
    placed = points.select("key", "lon", "lat").filter("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    placed = placed.withColumn("_cx", _cell(F.col("lon"), size)).withColumn("_cy", _cell(F.col("lat"), size))
    heavy = F.broadcast(placed.groupBy("_cx", "_cy").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select("_cx", "_cy", F.ceil(F.col("n") / HEAVY).alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("key", "lon", "lat"), blocks)
    none = F.lit(None).cast("double")
    left = placed.join(heavy, ["_cx", "_cy"], "left").select("_cx", "_cy", block.alias("block"), F.lit(1).alias("side"), "key", area.alias("area"), "lon", "lat", none.alias("maxx"), none.alias("maxy"), F.lit(None).cast("string").alias("wkt"))
    celled = _celled(_boxed(regions), size, margin).join(heavy, ["_cx", "_cy"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    right = celled.select("_cx", "_cy", "block", F.lit(0).alias("side"), key.alias("key"), "area", F.col("minx").alias("lon"), F.col("miny").alias("lat"), "maxx", "maxy", F.when(~F.col("box"), F.col("wkt")).alias("wkt"))
    met = left.unionByName(right).repartition("_cx", "_cy", "block").sortWithinPartitions("_cx", "_cy", "block", "side", "area")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for batch in batches:
            cx, cy, part, side = (batch.column(c).to_numpy() for c in ("_cx", "_cy", "block", "side"))
            lon, lat = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
            cuts = np.flatnonzero((np.diff(cx) != 0) | (np.diff(cy) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cx)]):
                if a == z:
                    continue
                if (here := (cx[a], cy[a], part[a])) != at:
                    at, held, ready = here, [], None
                if not side[a]:
                    held.append(batch.slice(a, z - a))
                    continue
                if not held:
                    continue
                if ready is None:
                    own = pa.Table.from_batches(held)
                    box = [own.column(c).to_numpy() for c in ("lon", "lat", "maxx", "maxy")]
                    ready = own.column("area").combine_chunks(), box, [(k, polygons(w)) for k, w in enumerate(own.column("wkt").to_pylist()) if w is not None]
                areas, box, others = ready
                if isinstance(areas, pa.ChunkedArray):
                    areas = pa.concat_arrays(areas.chunks)
                step = max(1, 100_000 // len(areas))
                for k in range(a, z, step):
                    end = min(z, k + step)
                    rows, found, *more = test(lon[k:end], lat[k:end], box, others)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([batch.column("key").slice(k, end - k).take(pa.array(rows)), areas.take(pa.array(found)), *map(pa.array, more)], names=names)

    kinds = f"key {points.schema['key'].dataType.simpleString()}, area {regions.schema['area'].dataType.simpleString()}{schema}"
    names = [c.split()[0] for c in kinds.split(", ")]
    return met.mapInArrow(run, kinds)


def _inside(x: np.ndarray, y: np.ndarray, box: list, others: list) -> np.ndarray:
    """Points by regions: whether the point is inside. Rectangles are half-open, as the even-odd rule is."""
    x0, y0, x1, y1 = box
    px, py = x[:, None], y[:, None]
    inside = (px >= x0) & (px < x1) & (py >= y0) & (py < y1)
    for k, parts in others:
        inside[:, k] = in_polygons(x, y, parts)
    return inside


def containing(points: DataFrame, regions: DataFrame, cell: float = 4.0) -> DataFrame:
    """(key, area) for every region (area, wkt) that holds a point (key, lon, lat)."""
    return _met(points, regions, cell, 0.0, lambda x, y, box, others: np.nonzero(_inside(x, y, box, others)), "")


def first_containing(points: DataFrame, regions: DataFrame, cell: float = 4.0) -> DataFrame:
    """(key, area): of the regions (area, wkt) that hold a point (key, lon, lat) the one of the smallest area key."""

    def least(x, y, box, others):
        inside = _inside(x, y, box, others)
        at = inside.argmax(axis=1)
        rows = np.flatnonzero(inside[np.arange(len(x)), at])
        return rows, at[rows]

    # among regions of equal text only the smallest key can be the first
    distinct = regions.groupBy("wkt").agg(F.min("area").alias("area"))
    return _met(points, distinct.filter("area is not null"), cell, 0.0, least, "").groupBy("key").agg(F.min("area").alias("area"))


def _distance(x: np.ndarray, y: np.ndarray, parts: list) -> np.ndarray:
    """How far points are from polygons, 0 inside."""
    best = np.full(len(x), np.inf)
    for rings in parts:
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0)):
                length = (bx - ax) ** 2 + (by - ay) ** 2
                along = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length, 0, 1) if length else 0.0
                best = np.minimum(best, np.hypot(ax + along * (bx - ax) - x, ay + along * (by - ay) - y))
    best[in_polygons(x, y, parts)] = 0
    return best


def containing_or_nearest(points: DataFrame, regions: DataFrame, distance: float, cell: float = 4.0) -> DataFrame:
    """(key, area, distance): a containing region (0) or the nearest one within ``distance``; ties go to the smaller area key."""

    def nearest(x, y, box, others):
        x0, y0, x1, y1 = box
        px, py = x[:, None] - x0, y[:, None] - y0
        dx, dy = np.maximum(np.maximum(-px, 0), px - (x1 - x0)), np.maximum(np.maximum(-py, 0), py - (y1 - y0))
        far = np.sqrt(dx * dx + dy * dy)
        for k, parts in others:
            near = np.flatnonzero(far[:, k] <= distance)
            measured = np.full(len(x), np.inf)
            measured[near] = _distance(x[near], y[near], parts)
            far[:, k] = measured
        far[far > distance] = np.inf
        # the regions are in the order of their keys, so the first of the least is the tie's winner
        rounded = np.floor(far * 1e9 + 0.5)
        at = rounded.argmin(axis=1)
        best = far[np.arange(len(x)), at]
        rows = np.flatnonzero(best <= distance)
        return rows, at[rows], best[rows]

    distinct = regions.groupBy("wkt").agg(F.min("area").alias("area"))
    near = _met(points, distinct.filter("area is not null"), cell, distance, nearest, ", distance double")
    best = near.groupBy("key").agg(F.min(F.struct(F.floor(F.col("distance") * 1e9 + 0.5).alias("rounded"), "area", "distance")).alias("b"))
    return best.select("key", "b.area", "b.distance")


def boxes_that_meet(regions: DataFrame, cell: float = 4.0) -> DataFrame:
    """(area_a, area_b) of regions whose boxes meet, each pair once: it is reported in the cell of the corner where both begin."""
    cells = region_cells(regions, cell)
    a = cells.select(*[F.col(c).alias(c + "_a") for c in ("area", "minx", "miny", "maxx", "maxy")], "_cx", "_cy")
    b = cells.select(*[F.col(c).alias(c + "_b") for c in ("area", "minx", "miny", "maxx", "maxy")], "_cx", "_cy")
    meet = (F.col("minx_a") <= F.col("maxx_b")) & (F.col("minx_b") <= F.col("maxx_a")) & (F.col("miny_a") <= F.col("maxy_b")) & (F.col("miny_b") <= F.col("maxy_a"))
    reference = (_cell(F.greatest("minx_a", "minx_b"), cell) == F.col("_cx")) & (_cell(F.greatest("miny_a", "miny_b"), cell) == F.col("_cy"))
    return a.join(b, ["_cx", "_cy"]).filter("area_a < area_b").filter(meet & reference).select("area_a", "area_b")
