"""From features with shapes to encoded tiles.

A feature row is (layer, id, kind, shape, minzoom, maxzoom, sort_key, attrs): kind is point, line or polygon, shape the world
coordinates as array<array<array<double>>> (parts of points), attrs a MAP<STRING,STRING>. The columns of ``OPTIONAL`` may be added. Points are
exploded to zooms and tiles by column expressions and never meet Python. Lines and polygons are sized, simplified and cut in one pass of Arrow
batches, as flat coordinate lists. The label limit is a plan; layer hooks and merging run in one stage that lets all other rows pass, so a
build renders each feature once. Tiles wholly inside a polygon are told by the kernel without cutting.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.kernels import batch as b
from terrane.kernels import geometry as g
from terrane.kernels import mvt
from terrane.kernels.lines import merge_lines
from terrane.operators.tiling import explode_zooms, limit_per_cell, point_tiles
from terrane.streams import group_starts, kernel_partitions, lists, one_batch, over_some_groups, whole_groups

FEATURE = "layer string, id bigint, kind string, shape array<array<array<double>>>, minzoom int, maxzoom int, sort_key int, attrs map<string,string>"
#: Columns that a feature may have besides: the zoom from which each attribute is shown, least sizes and buffer in pixels in place of the build's,
#: what point to make of the shape, stretches of a line (shares of its length) with attributes of their own, later ones over earlier ones, and
#: ``python`` where the row was made by a Python function, whose points are then placed in the kernel, so that the function runs once.
OPTIONAL = {
    "attr_zooms": "map<string,int>", "min_size": "double", "min_size_at_max": "double", "buffer": "double", "mode": "string",
    "stretches": "array<struct<start_at:double,end_at:double,attrs:map<string,string>>>", "made": "string",
}
#: ``xy`` are the coordinates in tile pixels, ``ends`` the number of points up to the end of each part.
RENDERED = "layer string, id bigint, kind string, z int, x int, y int, xy array<double>, ends array<int>, sort_key int, cell bigint, attrs map<string,string>, filled boolean"
_NAMES = [c.split()[0] for c in RENDERED.split(", ")]
_CUT = "layer string, id bigint, kind string, z int, x int, y int, xy array<double>, ends array<int>, sort_key int, cell bigint, attrs_text string, zooms_text string, filled boolean"
_CUT_NAMES = [c.split()[0] for c in _CUT.split(", ")]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
_SHAPED_ARROW = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in "layer string, id bigint, kind string, xy array<double>, ends array<int>, minzoom int, maxzoom int, sort_key int, attrs_text string, zooms_text string, min_size double, min_size_at_max double, buffer double, mode string".split(", "))])
#: Points that one call of a kernel should take, copies of them for the tiles included.
BATCH_POINTS = 300_000
_ERRORS = (ValueError, IndexError, TypeError, ZeroDivisionError)


@dataclass(frozen=True)
class RenderOptions:
    """Pixels at each zoom below the last one rendered, and at it."""

    buffer: float = 4.0
    min_size: float = 1.0
    min_size_at_max: float = 1 / 16
    tolerance: float = 0.1
    tolerance_at_max: float = 1 / 16
    render_maxzoom: int = 14
    simplify: str | Callable = "douglas_peucker"  # or a function (line in pixels, tolerance, is a ring) -> line
    grid_px: float = 0.0
    grid_limit: int = 0
    grid_maxzoom: int = 14
    extents: tuple | None = None

    def at(self, zoom: int) -> tuple[float, float]:
        top = zoom >= self.render_maxzoom
        return (self.min_size_at_max, self.tolerance_at_max) if top else (self.min_size, self.tolerance)


SIMPLIFIERS: dict[str, Callable] = {
    "douglas_peucker": lambda line, t, ring: g.douglas_peucker(line, t, ring),
    "visvalingam": lambda line, t, ring: g.visvalingam(line, t, 0.0, ring),
    "visvalingam_weighted": lambda line, t, ring: g.visvalingam(line, t, 0.7, ring),
}


def flat(parts: list) -> tuple[np.ndarray, list[int]]:
    """``xy`` and ``ends`` of parts."""
    arrays = [np.asarray(p, dtype=float).reshape(-1, 2) for p in parts]
    return (np.concatenate(arrays).ravel() if arrays else np.zeros(0)), np.cumsum([len(a) for a in arrays]).tolist()


def parts_of(xy, ends) -> list[np.ndarray]:
    """The parts that ``flat`` made flat."""
    points = np.asarray(xy, dtype=float).reshape(-1, 2)
    return np.split(points, ends[:-1]) if len(ends) > 1 else [points]


def _point_of(mode: str, kind: str, parts: list[np.ndarray]) -> np.ndarray | None:
    """The point that a geometry mode makes of a line or polygon."""
    if kind == "line":
        line = max(parts, key=g.length)
        if mode in ("line_midpoint", "point_on_line", "innermost_point"):
            return g.along(line, 0.5)
        return g.line_centroid(line)
    rings = [g.closed(r) for r in parts]
    if mode == "polygon_point_on_surface":
        return g.point_on_surface(rings)
    if mode == "innermost_point":
        return g.innermost_point(rings)
    if mode == "polygon_centroid_if_convex":
        return g.centroid_if_convex(rings)
    return g.centroid(rings)


def _stretched(line: np.ndarray, stretches, attrs: dict) -> Iterator[tuple[np.ndarray, dict]]:
    """The pieces of a line between the ends of its stretches, with the attributes of all stretches over them; equal neighbours are one."""
    cuts = sorted({0.0, 1.0, *(min(1.0, max(0.0, v)) for s in stretches for v in (s["start_at"], s["end_at"]))})
    runs: list[list] = []
    for a, z in zip(cuts, cuts[1:]):
        own = dict(attrs)
        for s in stretches:
            if s["start_at"] <= a and s["end_at"] >= z:
                own |= dict(s["attrs"] or {})
        if runs and runs[-1][2] == own:
            runs[-1][1] = z
        else:
            runs.append([a, z, own])
    for a, z, own in runs:
        yield (line if (a, z) == (0.0, 1.0) else g.part(line, a, z)), own


def _pieces(kind: str, parts: list[np.ndarray], zoom: int, options: RenderOptions, least: float, buffer: float):
    """(x, y, parts in pixels, filled) of one line or polygon at one zoom."""
    tolerance = options.at(zoom)[1]
    to_px = 256.0 * (1 << zoom)
    simplify = options.simplify if callable(options.simplify) else SIMPLIFIERS[options.simplify]
    extent = options.extents[zoom] if options.extents else None
    if kind == "line":
        for line in parts:
            if g.length(line) * to_px < least:
                continue
            slim = simplify(line * to_px, tolerance, False) / to_px if len(line) > 2 else line
            for x, y, cut, _ in g.slice_to_tiles("line", slim, zoom, buffer, extent):
                yield x, y, cut, False
        return
    rings = [g.closed(r) for r in parts]
    if np.sqrt(max(g.area(rings), 0)) * to_px < least:
        return
    slim = [simplify(r * to_px, tolerance, True) / to_px for r in rings if np.sqrt(abs(g.signed_area(r))) * to_px >= least]
    if slim:
        for x, y, cut, filled in g.slice_to_tiles("polygon", slim, zoom, buffer, extent):
            yield x, y, [r for part in cut for r in part], filled


def _cell(x: Column, y: Column, zoom: Column, options: RenderOptions) -> Column:
    """The label cell of a place in the world at a zoom."""
    n = F.pow(F.lit(2.0), zoom)
    size = options.grid_px / 256
    column, row = F.floor(F.pmod(x * n, n) / size).cast("bigint"), F.floor(y * n / size).cast("bigint")
    return F.when(zoom <= options.grid_maxzoom, F.call_function("shiftleft", column, F.lit(32)).bitwiseOR(row.bitwiseAND(F.lit(0xFFFFFFFF))))


def _shown(attrs: Column, attr_zooms: Column) -> Column:
    return F.when(attr_zooms.isNull(), attrs).otherwise(F.map_filter(attrs, lambda k, v: F.col("z") >= F.coalesce(F.try_element_at(attr_zooms, k), F.lit(0))))


def _points(features: DataFrame, options: RenderOptions) -> DataFrame:
    """Points on tiles, by columns alone."""
    made = features.select("*", (F.size(F.get("shape", F.lit(0))) == 1).alias("single"), F.explode(F.get("shape", F.lit(0))).alias("at")).drop("shape")
    made = made.withColumn("wx", F.get("at", F.lit(0))).withColumn("wy", F.get("at", F.lit(1))).drop("at").filter("wx is not null and wy is not null and not isnan(wx) and not isnan(wy)")
    zoomed = explode_zooms(made, F.col("minzoom"), F.col("maxzoom"))
    cell = F.when(F.col("single"), _cell(F.col("wx"), F.col("wy"), F.col("z"), options)) if options.grid_px else F.lit(None)
    placed = point_tiles(zoomed.withColumn("cell", cell.cast("bigint")), F.coalesce("buffer", F.lit(float(options.buffer))))
    if options.extents:
        inside = F.lit(False)
        for zoom, (x0, y0, x1, y1) in enumerate(options.extents):
            inside = inside | ((F.col("z") == zoom) & (F.col("tx") >= x0) & (F.col("tx") < x1) & (F.col("ty") >= y0) & (F.col("ty") < y1))
        placed = placed.filter(inside)
    return placed.select(
        "layer", "id", "kind", F.col("z").cast("int").alias("z"), F.col("tx").cast("int").alias("x"), F.col("ty").cast("int").alias("y"), F.array("px", "py").alias("xy"), F.array(F.lit(1)).alias("ends"),
        "sort_key", "cell", _shown(F.col("attrs"), F.col("attr_zooms")).alias("attrs"), F.lit(False).alias("filled"),
    )


def with_optional(features: DataFrame) -> DataFrame:
    return features.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in features.columns})


def render(features: DataFrame, options: RenderOptions = RenderOptions(), derives: bool = True, failed: Callable[[], None] | None = None) -> DataFrame:
    """One row per feature, zoom and tile (``RENDERED``). A feature whose shape fails is skipped at that zoom and ``failed`` is told; the others go on.

    ``derives`` says that modes may make points of lines or polygons; without it only points have label cells.
    """
    spread = with_optional(features).filter("shape is not null and minzoom <= maxzoom")
    plain_point = (F.col("kind") == "point") & F.coalesce(F.col("made") != "python", F.lit(True))

    def one_by_one(frame: pd.DataFrame, zooms_only: tuple[int, ...] | None = None) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        columns = ("layer", "id", "kind", "xy", "ends", "minzoom", "maxzoom", "sort_key", "attrs_text", "zooms_text", "min_size", "min_size_at_max", "buffer", "mode", "stretches")
        for layer, id_, kind, xy, ends, low, high, key, attrs, zooms, size, size_at_max, buffer, mode, stretches in zip(*(frame[c] for c in columns)):
            buffer = options.buffer if buffer is None or buffer != buffer else buffer
            try:
                parts = parts_of(xy, ends)
                if mode is not None or kind == "point":
                    points = parts[0] if kind == "point" else [_point_of(mode, _source_kind(mode, parts), parts)]
                    for point in points:
                        for zoom in range(low, high + 1) if point is not None else ():
                            rows += [(layer, id_, "point", zoom, x, y, at, [1], key, cell if len(points) == 1 else None, attrs, zooms, False) for x, y, at, cell in _on_tiles(point, zoom, buffer, options)]
                    continue
                given = [(parts, attrs)]
                if stretches is not None and len(stretches) and kind == "line":
                    given = [([line], json.dumps(own)) for part in parts for line, own in _stretched(part, stretches, json.loads(attrs or "{}"))]
            except _ERRORS:
                if failed:
                    failed()
                continue
            for zoom in zooms_only or range(low, high + 1):
                least = options.at(zoom)[0]
                own_size = size_at_max if zoom >= options.render_maxzoom else size
                least = least if own_size is None or own_size != own_size else own_size
                for some, text in given:
                    try:
                        rows += [(layer, id_, kind, zoom, x, y, *flat(made), key, None, text, zooms, filled) for x, y, made, filled in _pieces(kind, some, zoom, options, least, buffer)]
                    except _ERRORS:
                        if failed:
                            failed()
                if len(rows) >= 4000:
                    yield _frame(rows, _CUT_NAMES)
                    rows = []
        if rows:
            yield _frame(rows, _CUT_NAMES)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            batch = pa.RecordBatch.from_pandas(frame[_SHAPED_ARROW.names], _SHAPED_ARROW, preserve_index=False)
            stretched = np.array([s is not None and len(s) > 0 for s in frame["stretches"]], dtype=bool)
            known = _Shapes.of(batch, stretched) if options.simplify == "douglas_peucker" else None
            together = np.zeros(len(frame), dtype=bool) if known is None else known.plain
            if not together.all():
                yield from one_by_one(frame[~together])
            for zoom in range(int(known.low[together].min()), int(known.high[together].max()) + 1) if together.any() else ():
                for kind in ("line", "polygon"):
                    for rows in known.portions(kind, zoom):
                        try:
                            if known.weight > BATCH_POINTS:
                                raise ValueError("too large a shape to be cut at once")
                            made = known.cut(kind, rows, zoom, options)
                        except _ERRORS:
                            yield from one_by_one(frame.iloc[rows], (zoom,))
                            continue
                        yield from _cut_rows(batch, zoom, *made)

    shaped = spread.filter(~plain_point).select(
        "layer", "id", "kind", F.flatten(F.flatten("shape")).alias("xy"), F.aggregate("shape", F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + F.size(p)))).alias("ends"),
        "minzoom", "maxzoom", "sort_key", F.to_json("attrs").alias("attrs_text"), F.to_json("attr_zooms").alias("zooms_text"), "min_size", "min_size_at_max", "buffer", "mode", "stretches",
    )
    # cutting costs far more time than its bytes tell, so small shuffle partitions must not have been joined into few tasks
    made = shaped.repartition(kernel_partitions(shaped), "id", "layer").mapInPandas(cut, _CUT)
    attrs = _shown(F.from_json("attrs_text", "map<string,string>"), F.from_json("zooms_text", "map<string,int>"))
    cell = F.col("cell") if derives and options.grid_px else F.lit(None).cast("bigint")
    slices = made.select("layer", "id", "kind", "z", "x", "y", "xy", "ends", "sort_key", cell.alias("cell"), attrs.alias("attrs"), "filled")
    return _points(spread.filter(plain_point), options).unionByName(slices)


@dataclass
class _Shapes:
    """The lines and polygons of an Arrow batch as flat points; ``plain`` are the rows that can be cut together."""

    points: np.ndarray
    offsets: np.ndarray  # of the parts
    parts: np.ndarray  # the first part of each row
    kind: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    size_at_max: np.ndarray
    buffer: np.ndarray
    plain: np.ndarray
    measured: dict
    weight: float = 0.0

    @classmethod
    def of(cls, batch: pa.RecordBatch, stretched: np.ndarray) -> _Shapes | None:
        """None if a row is not made of pairs of numbers."""
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        xy, at = lists(batch.column("xy"))
        ends, parts = lists(batch.column("ends"))
        which, rank = b.repeated(np.diff(parts))
        last = np.zeros(batch.num_rows, dtype=np.int64)
        some = np.diff(parts) > 0
        last[some] = ends[parts[1:][some] - 1]
        if (2 * last != np.diff(at)).any() or batch.column("ends").flatten().null_count:
            return None
        points = xy.astype(float).reshape(-1, 2)
        stops = at[:-1][which] // 2 + ends
        offsets = np.concatenate([[0], stops]).astype(np.int64)
        kind = column("kind")
        plain = some & pc.is_null(batch.column("mode")).to_numpy(zero_copy_only=False) & ~stretched & np.isin(kind, ("line", "polygon"))
        odd = np.zeros(len(which), dtype=bool)
        count = np.diff(offsets)
        odd |= np.bincount(np.repeat(np.arange(len(count)), count), ~np.isfinite(points).all(axis=1), len(count)) > 0
        odd |= count == 0
        filled = np.flatnonzero(~odd)
        open_ = np.zeros(len(which), dtype=bool)
        open_[filled] = (points[offsets[:-1][filled]] != points[offsets[1:][filled] - 1]).any(axis=1)
        odd |= open_ & (kind[which] == "polygon")
        plain &= np.bincount(which, odd, batch.num_rows) == 0
        return cls(points, offsets, parts, kind, column("minzoom"), column("maxzoom"), column("min_size").astype(float), column("min_size_at_max").astype(float), column("buffer").astype(float), plain, {})

    def _weights(self, kind: str, rows: np.ndarray, zoom: int) -> np.ndarray:
        """About how many points cutting each row handles."""
        if "span" not in self.measured:
            first, last = self.offsets[self.parts[:-1]], self.offsets[self.parts[1:]]
            self.measured["span"], self.measured["n"] = np.zeros((len(first), 2)), last - first
            some = np.flatnonzero(self.plain)
            at, offsets = b.taken(np.stack([first, last], axis=1).ravel(), some * 2)
            if len(some):
                self.measured["span"][some] = np.maximum.reduceat(self.points[at], offsets[:-1]) - np.minimum.reduceat(self.points[at], offsets[:-1])
            seg, part = b.segments(self.offsets)
            way = np.abs(self.points[seg + 1] - self.points[seg]).sum(axis=1)
            self.measured["way"] = np.bincount(np.repeat(np.arange(len(first)), np.diff(self.parts))[part], np.where(np.isfinite(way), way, 0), len(first))
        span, n = self.measured["span"][rows] * (1 << zoom) + 2, self.measured["n"][rows]
        if kind == "line":
            return 3 * n + 3 * self.measured["way"][rows] * (1 << zoom)
        return n * span[:, 0] + span[:, 1] * (n + 8 * span[:, 0])

    def portions(self, kind: str, zoom: int) -> Iterator[np.ndarray]:
        """The rows of a kind that are shown at a zoom, as many at once as ``BATCH_POINTS`` allows; ``weight`` is that of the rows given last."""
        rows = np.flatnonzero(self.plain & (self.kind == kind) & (self.low <= zoom) & (self.high >= zoom))
        if not len(rows):
            return
        weights = self._weights(kind, rows, zoom)
        large = weights > BATCH_POINTS
        for row, weight in zip(rows[large], weights[large]):
            self.weight = float(weight)
            yield np.array([row])
        rows, weights = rows[~large], weights[~large]
        portion = (np.cumsum(weights) // BATCH_POINTS).astype(np.int64)
        for some in np.split(rows, np.flatnonzero(np.diff(portion)) + 1):
            self.weight = 0.0
            if len(some):
                yield some

    def cut(self, kind: str, rows: np.ndarray, zoom: int, options: RenderOptions):
        """(row, x, y, number of parts, filled) on every tile, the points in tile pixels and the offsets of the parts."""
        least, tolerance = options.at(zoom)
        own = (self.size_at_max if zoom >= options.render_maxzoom else self.size)[rows]
        least = np.where(np.isnan(own), least, own)
        buffer = np.where(np.isnan(self.buffer[rows]), options.buffer, self.buffer[rows])
        to_px = 256.0 * (1 << zoom)
        extent = options.extents[zoom] if options.extents else None
        which, rank = b.repeated(np.diff(self.parts)[rows])
        at, offsets = b.taken(self.offsets, self.parts[:-1][rows][which] + rank)
        points = self.points[at]
        if kind == "line":
            left = np.flatnonzero(b.lengths(points, offsets) * to_px >= least[which])
            at, offsets = b.taken(offsets, left)
            which = which[left]
            points, offsets = b.douglas_peucker(points[at] * to_px, offsets, tolerance)
            line, x, y, number, flat, parts = b.slice_lines(points / to_px, offsets, zoom, buffer[which], extent)
            return rows[which[line]], x, y, number, np.zeros(len(x), dtype=bool), flat, parts
        areas = np.abs(b.signed_areas(points, offsets))
        whole = np.bincount(which, np.where(rank == 0, areas, -areas), len(rows))
        left = np.flatnonzero((np.sqrt(areas) * to_px >= least[which]) & (np.sqrt(np.maximum(whole, 0)) * to_px >= least)[which])
        if not len(left):
            return rows[:0], rows[:0], rows[:0], rows[:0], rows[:0] > 0, points[:0], np.zeros(1, dtype=np.int64)
        at, offsets = b.taken(offsets, left)
        shown, which = np.unique(which[left], return_inverse=True)
        points, offsets = b.douglas_peucker(points[at] * to_px, offsets, tolerance, True)
        first = b.offsets_of(np.bincount(which, minlength=len(shown)))
        polygon, x, y, number, filled, flat, parts = b.slice_polygons(points / to_px, offsets, first, zoom, buffer[shown], extent)
        return rows[shown[polygon]], x, y, number, filled, flat, parts


def _list_arrays(points: np.ndarray, offsets: np.ndarray, number: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """``xy`` and ``ends`` of rows of ``number`` parts each."""
    parts = b.offsets_of(number)
    starts = offsets[parts]
    ends = offsets[1:] - np.repeat(starts[:-1], number)
    flat = np.ascontiguousarray(points, dtype=float).ravel()
    return pa.ListArray.from_arrays(pa.array((starts * 2).astype(np.int32)), pa.array(flat)), pa.ListArray.from_arrays(pa.array(parts.astype(np.int32)), pa.array(ends.astype(np.int32)))


def _cut_rows(batch: pa.RecordBatch, zoom: int, row, x, y, number, filled, points, offsets) -> Iterator[pd.DataFrame]:
    xy, ends = _list_arrays(points, offsets, number)
    at = pa.array(row)
    taken = {n: batch.column(n).take(at) for n in ("layer", "id", "kind", "sort_key", "attrs_text", "zooms_text")}
    made = taken | {"z": pa.array(np.full(len(row), zoom, dtype=np.int32)), "x": pa.array(x.astype(np.int32)), "y": pa.array(y.astype(np.int32)), "xy": xy, "ends": ends, "cell": pa.nulls(len(row), pa.int64()), "filled": pa.array(filled)}
    for start in range(0, len(row), 10_000):
        # Arrow columns go back to Arrow without a Python object a row
        yield pd.DataFrame({n: pd.arrays.ArrowExtensionArray(pa.chunked_array([made[n].slice(start, 10_000)])) for n in _CUT_NAMES})


def _source_kind(mode: str, parts: list[np.ndarray]) -> str:
    """Whether the shape under a mode is a line or a polygon: told by the mode, or by whether it is closed."""
    if mode.startswith("line") or mode == "point_on_line":
        return "line"
    if mode.startswith("polygon"):
        return "polygon"
    return "polygon" if len(parts[0]) >= 4 and (parts[0][0] == parts[0][-1]).all() else "line"


def _on_tiles(point: np.ndarray, zoom: int, buffer: float, options: RenderOptions) -> Iterator[tuple[int, int, list[float], int | None]]:
    """(x, y, place in pixels, label cell) on every tile whose buffered square holds the point."""
    n = 1 << zoom
    sx, sy = float(point[0]) * n, float(point[1]) * n
    b = buffer / 256 + 0.1 / mvt.EXTENT
    cell = None
    if options.grid_px and zoom <= options.grid_maxzoom:
        size = options.grid_px / 256
        cell = (int(np.floor(sx % n / size)) << 32) | (int(np.floor(sy / size)) & 0xFFFFFFFF)
    for x in range(int(np.floor(sx - b)), int(np.floor(sx + b)) + 1):
        for y in range(max(0, int(np.floor(sy - b))), min(n - 1, int(np.floor(sy + b))) + 1):
            yield x % n, y, [(sx - x) * 256, (sy - y) * 256], cell


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    frame["cell"] = frame["cell"].astype("Int64")
    return frame


def label_limited(rendered: DataFrame, options: RenderOptions, derives: bool = False) -> DataFrame:
    """At most ``grid_limit`` labels of each layer in a cell; ``derives`` as in ``render``."""
    if not options.grid_px or options.grid_limit < 1:
        return rendered
    if not derives:
        return limit_per_cell(rendered, "cell", options.grid_limit, ["z", "x", "y", "layer"], [F.col("sort_key"), F.col("id")])
    # rows without a cell are each a group of their own, so that the kernel's rows are read once
    alone = F.when(F.col("cell").isNull(), F.xxhash64("id", "kind"))
    rank = F.row_number().over(Window.partitionBy("z", "x", "y", "layer", "cell", alone).orderBy("sort_key", "id"))
    return rendered.withColumn("_rank", rank).filter((F.col("_rank") <= options.grid_limit) | F.col("cell").isNull()).drop("_rank")


def _merge_kinds(layers: dict[str, dict]) -> dict[str, str]:
    return {name: ("polygon" if "min_area" in p or p.get("kind") == "polygon" else "line") for name, p in layers.items()}


def _merges_together(layers: dict[str, dict]) -> bool:
    """Whether the groups of all layers can be merged a batch at a time."""
    return not any(set(p) - {"kind", "min_length", "tolerance", "min_area", "min_hole_area"} for p in layers.values())


def _merged_alone(group: pd.DataFrame, layers: dict[str, dict], failed: Callable[[], None] | None) -> Iterator[pd.DataFrame]:
    """One group, its features as they were if that fails."""
    first = group.iloc[0]
    p = dict(layers[first["layer"]])
    kind = _merge_kinds(layers)[first["layer"]]
    try:
        if kind == "line":
            p.pop("kind", None)
            if callable(p.get("min_length")):
                p["min_length"] = p["min_length"](dict(first["attrs"] or ()), int(first["z"]))
            shapes = [merge_lines([part for xy, ends in zip(group["xy"], group["ends"]) for part in parts_of(xy, ends)], **p)]
        else:
            polygons = g.nest_all([parts_of(xy, ends) for xy, ends in zip(group["xy"], group["ends"])])
            near = p.get("min_distance", 0.0)
            whole = g.buffered(g.buffered(polygons, near / 2), -near / 2) if near else g.merged_union(polygons)
            whole = [[r for k, r in enumerate(q) if k == 0 or abs(g.signed_area(r)) >= p.get("min_hole_area", 0.0)] for q in whole if g.area(q) >= p.get("min_area", 0.0)]
            shapes = whole
    except (ValueError, IndexError, ZeroDivisionError):  # the features stay as they were
        if failed:
            failed()
        yield group[_NAMES]
        return
    id_ = int(group["id"].min())
    id_ = id_ // 10 * 10 if len(group) > 1 else id_
    rows = [(first["layer"], id_, kind, first["z"], first["x"], first["y"], *flat(s), int(group["sort_key"].min()), None, first["attrs"], False) for s in shapes if s]
    if rows:
        yield _frame(rows, _NAMES)

def merged(rendered: DataFrame, layers: dict[str, dict], failed: Callable[[], None] | None = None) -> DataFrame:
    """Merge lines or polygons of equal attributes in each tile, for the layers named (with the kernel's parameters).

    The key holds the attributes, so one heavy tile is many groups; other rows pass by in the same stage. ``min_length`` of lines may be a
    function of (attributes, zoom).
    """
    kinds = _merge_kinds(layers)
    touched = F.lit(False)
    for name, kind in kinds.items():
        touched = touched | ((F.col("layer") == name) & (F.col("kind") == kind))

    def keyed(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        # the hash brings equal attributes together; what differs in spite of it is told apart here
        texts = group["attr_text"]
        if texts.nunique(dropna=False) == 1:
            yield from _merged_alone(group, layers, failed)
            return
        for _, some in group.groupby("attr_text", dropna=False, sort=True):
            yield from _merged_alone(some, layers, failed)

    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs"))))
    known = rendered.withColumn("attr_text", F.when(touched, text)).withColumn("attr_key", F.when(touched, F.xxhash64("attr_text")).otherwise(0))
    if not _merges_together(layers):
        return over_some_groups(known, touched, ["z", "x", "y", "layer", "attr_key"], keyed, RENDERED)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = iter(batches)
        awake: list[pa.RecordBatch] = []
        for batch in held:  # sorted, so the idle rows come first
            idle = batch.num_rows - int(pc.sum(batch.column("_active").cast(pa.int32())).as_py() or 0)
            if idle:
                yield batch.slice(0, idle).select(_NAMES)
            if idle < batch.num_rows:
                awake.append(batch.slice(idle))
                break
        # equal hashes of different attributes are told apart by the text
        for batch, starts in whole_groups(chain(awake, held), ["z", "x", "y", "layer", "attr_text"]):
            yield from _merged_groups(batch, starts, layers, failed)

    spread = F.when(F.col("_active"), 0).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(1024)))
    keys = ["z", "x", "y", "layer", "attr_key"]
    placed = known.withColumn("_active", F.coalesce(touched, F.lit(False))).repartition(kernel_partitions(known), *keys, spread).sortWithinPartitions("_active", *keys, "attr_text")
    return placed.mapInArrow(together, RENDERED)


def _merged_groups(batch: pa.RecordBatch, starts: np.ndarray, layers: dict[str, dict], failed: Callable[[], None] | None) -> Iterator[pa.RecordBatch]:
    """The merged rows of groups that have one tile, layer and set of attributes each; attributes are told as ``attrs`` or ``attrs_text``."""
    kinds, columns = _merge_kinds(layers), [c for c in (*_NAMES, "attrs_text") if c in batch.schema.names]
    names = np.array(batch.column("layer").take(pa.array(starts)).to_pylist(), dtype=object)
    for name in dict.fromkeys(names.tolist()):
        chosen = np.flatnonzero(names == name)
        rows, own = b.taken(np.append(starts, batch.num_rows), chosen)
        some = batch if len(chosen) == len(starts) else batch.take(pa.array(rows))
        try:
            made = (_merged_lines if kinds[name] == "line" else _merged_polygons)(some, own, layers[name])
        except _ERRORS:
            schema = pa.schema([batch.schema.field(n).with_nullable(True) for n in columns])
            for a, z in zip(own.tolist(), own[1:].tolist()):
                group = some.slice(a, z - a).to_pandas()
                if "attrs" not in columns:
                    group["attrs"], group["cell"] = [list(json.loads(t).items()) if t else None for t in group["attrs_text"]], None
                for frame in _merged_alone(group, layers, failed):
                    if "attrs" not in columns:
                        frame["attrs_text"] = group["attrs_text"].iloc[0]
                    yield pa.RecordBatch.from_pandas(frame[columns], schema, preserve_index=False)
            continue
        yield from made


def _merged_rows(batch: pa.RecordBatch, own: np.ndarray, group: np.ndarray, kind: str, xy: pa.ListArray, ends: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """Rows made of the groups ``group``; group k had the rows own[k]:own[k + 1]."""
    first = pa.array(own[:-1][group])
    ids = np.minimum.reduceat(batch.column("id").to_numpy(zero_copy_only=False), own[:-1])
    ids = np.where(np.diff(own) > 1, ids // 10 * 10, ids)
    keys = np.minimum.reduceat(batch.column("sort_key").to_numpy(zero_copy_only=False), own[:-1])
    n = len(group)
    given = batch.schema.names
    made = {c: batch.column(c).take(first) for c in ("layer", "z", "x", "y", "attrs", "attrs_text") if c in given}
    made |= {"id": pa.array(ids[group].astype(np.int64)), "kind": pa.array([kind] * n, pa.string()), "xy": xy, "ends": ends, "sort_key": pa.array(keys[group].astype(np.int32)), "cell": pa.nulls(n, pa.int64()), "filled": pa.array(np.zeros(n, dtype=bool))}
    columns = [c for c in (*_NAMES, "attrs_text") if c in given]
    whole = pa.RecordBatch.from_arrays([made[c] for c in columns], names=columns)
    for start in range(0, n, 10_000):
        yield whole.slice(start, 10_000)


def _merged_layers(batch: pa.RecordBatch, starts: np.ndarray, layers: dict[str, dict], failed: Callable[[], None] | None) -> tuple[pa.RecordBatch, np.ndarray]:
    """Whole layers of tiles, sorted as ``encode_tiles`` wants them, after merging, and where each starts."""
    kinds, keys = _merge_kinds(layers), ["z", "x", "y", "layer"]
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
    wanted = np.array([kinds.get(n) for n in batch.column("layer").take(pa.array(starts)).to_pylist()], dtype=object)
    touched = np.array(batch.column("kind").to_pylist(), dtype=object) == wanted[of]
    if not touched.any():
        return batch, starts
    texts = batch.column("attrs_text").dictionary_encode()
    numbers: dict[str | None, int] = {}
    known = [numbers.setdefault(json.dumps(sorted(json.loads(t).items())), len(numbers)) for t in texts.dictionary.to_pylist()] + [-1]
    code = np.array(known)[texts.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]
    rows = np.flatnonzero(touched)
    rows = rows[np.lexsort((code[rows], of[rows]))]  # stable
    change = np.ones(len(rows), dtype=bool)
    change[1:] = (of[rows][1:] != of[rows][:-1]) | (code[rows][1:] != code[rows][:-1])
    columns = [c for c in (*_NAMES, "attrs_text") if c in batch.schema.names]
    rest = batch.take(pa.array(np.flatnonzero(~touched))).select(columns)
    made = [rest, *_merged_groups(batch.take(pa.array(rows)), np.flatnonzero(change), layers, failed)]
    table = pa.Table.from_batches([pa.RecordBatch.from_arrays(m.columns, names=columns) for m in made])
    done = one_batch(table.sort_by([(k, "ascending") for k in (*keys, "sort_key", "id")]).combine_chunks().to_batches() or [rest])
    return done, group_starts(done, keys)


def _merged_lines(batch: pa.RecordBatch, own: np.ndarray, p: dict) -> Iterator[pa.RecordBatch]:
    groups = len(own) - 1
    points, offsets, row = _parts(batch)
    least = p.get("min_length", 0.0)
    if callable(least):
        first = pa.array(own[:-1])
        attrs = batch.column("attrs").take(first).to_pylist() if "attrs" in batch.schema.names else [json.loads(t) if t else None for t in batch.column("attrs_text").take(first).to_pylist()]
        told = zip(attrs, batch.column("z").take(first).to_pylist())
        least = np.array([least(dict(attrs or ()), z) for attrs, z in told], dtype=float)
    of = np.repeat(np.arange(groups), np.diff(own))[row]
    points, offsets, of = b.merge_lines(points, offsets, of, np.broadcast_to(np.asarray(least, dtype=float), groups), p.get("tolerance", -1.0))
    number = np.bincount(of, minlength=groups)
    left = np.flatnonzero(number)
    return _merged_rows(batch, own, left, "line", *_list_arrays(points, offsets, number[left]))


def _merged_polygons(batch: pa.RecordBatch, own: np.ndarray, p: dict) -> Iterator[pa.RecordBatch]:
    points, offsets, row = _parts(batch)
    rings = np.searchsorted(row, np.arange(batch.num_rows + 1))
    areas = b.signed_areas(points, offsets)
    bounds = offsets.tolist()
    found: list[list[g.Polygon]] = []  # the clusters of all groups
    of: list[int] = []
    for k, (low, high) in enumerate(zip(own.tolist(), own[1:].tolist())):
        polygons: list[g.Polygon] = []
        for r in range(low, high):
            first, last = int(rings[r]), int(rings[r + 1])
            if last - first == 1 and bounds[last] - bounds[first] >= 4:
                ring = points[bounds[first] : bounds[last]]
                shut = g.closed(ring)
                polygons.append([shut if (areas[first] if shut is ring else g.signed_area(shut)) > 0 else shut[::-1]])
            else:
                polygons += g.nest([points[bounds[m] : bounds[m + 1]] for m in range(first, last) if bounds[m + 1] - bounds[m] >= 4])
        some = [polygons] if len(polygons) == 1 else g.clusters(polygons)
        found += some
        of += [k] * len(some)
    shared = [k for k, c in enumerate(found) if len(c) > 1]
    for start in range(0, len(shared), 1000):
        some = shared[start : start + 1000]
        made = b.unions([q for k in some for q in found[k]], np.repeat(np.arange(len(some)), [len(found[k]) for k in some]))
        for k, whole in zip(some, made):
            found[k] = whole
    group, number, kept = [], [], []
    for k, polygons in zip(of, found):
        for polygon in polygons:
            if g.area(polygon) >= p.get("min_area", 0.0):
                shown = [r for m, r in enumerate(polygon) if m == 0 or abs(g.signed_area(r)) >= p.get("min_hole_area", 0.0)]
                group.append(k)
                number.append(len(shown))
                kept += shown
    flat_points = np.concatenate(kept) if kept else np.zeros((0, 2))
    made_offsets = b.offsets_of(np.array([len(r) for r in kept], dtype=np.int64))
    return _merged_rows(batch, own, np.array(group, dtype=np.int64), "polygon", *_list_arrays(flat_points, made_offsets, np.array(number, dtype=np.int64)))


def _parts(batch: pa.RecordBatch, one: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points of rendered rows, the offsets of their parts, and the row of each part; ``one`` are the rows of which only the first part counts."""
    xy, at = lists(batch.column("xy"))
    ends, parts = lists(batch.column("ends"))
    row, rank = b.repeated(np.diff(parts))
    stops = at[:-1][row] // 2 + ends
    starts = np.where(rank == 0, at[:-1][row] // 2, np.concatenate([[0], stops[:-1]])).astype(np.int64)
    points = xy.astype(float).reshape(-1, 2)
    if one is not None and (one[row] & (rank > 0)).any() or (starts[1:] != stops[:-1]).any() or len(starts) and (starts[0] or stops[-1] != len(points)):
        keep = np.flatnonzero(~(one[row] & (rank > 0))) if one is not None else np.arange(len(row))
        took, offsets = b.taken(np.stack([starts, stops], axis=1).ravel(), keep * 2)
        return points[took], offsets, row[keep]
    return points, np.concatenate([[0], stops]).astype(np.int64), row


def encode_tiles(rendered: DataFrame, compression: str = "gzip", skip_filled: bool = False, merge: dict[str, dict] | None = None, failed: Callable[[], None] | None = None) -> DataFrame:
    """(z, x, y, data, n_features) of every tile with a feature. Layers in ``merge`` are merged as by ``merged`` where they are encoded, which saves a shuffle of all rows.

    Layers are encoded on their own first, keyed by (tile, layer), and the encoded layers of a tile are then joined: a vector tile is the
    concatenation of its layers, so no task needs all features of a heavy tile.
    """

    if merge and not _merges_together(merge):
        rendered, merge = merged(rendered, merge, failed), None
    ordered = rendered.select("z", "x", "y", "layer", "sort_key", "id", "kind", "xy", "ends", F.to_json("attrs").alias("attrs_text"), "filled")
    spread = ordered.repartition(kernel_partitions(ordered), "z", "x", "y", "layer").sortWithinPartitions("z", "x", "y", "layer", "sort_key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, ["z", "x", "y", "layer"]):
            if merge:
                batch, starts = _merged_layers(batch, starts, merge, failed)
            if not batch.num_rows:
                continue
            texts = batch.column("attrs_text").dictionary_encode()
            known = [json.loads(text) if text else {} for text in texts.dictionary.to_pylist()] + [{}]
            attrs = texts.indices.fill_null(len(known) - 1).to_pylist()
            kinds = np.array([mvt.KINDS[k] for k in batch.column("kind").to_pylist()])
            points, offsets, row = _parts(batch, kinds == mvt.KINDS["point"])
            features = list(zip(batch.column("id").to_pylist(), kinds.tolist(), mvt.packed_commands(kinds, points, offsets, row), attrs))
            del points
            filled = np.logical_and.reduceat(batch.column("filled").to_numpy(zero_copy_only=False).astype(bool), starts)
            names = batch.column("layer").take(pa.array(starts))
            counts = np.diff(np.append(starts, batch.num_rows))
            data, first, held = [], 0, 0

            def made(first: int) -> pa.RecordBatch:
                some = [k for k, d in enumerate(data, first) if d]
                at = pa.array(starts[some])
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("z", "x", "y")), names.take(pa.array(some, pa.int64())), pa.array([d for d in data if d], pa.binary()), pa.array(counts[some]), pa.array(filled[some])], ["z", "x", "y", "layer", "data", "n", "filled"])

            for k, (a, n, name) in enumerate(zip(starts.tolist(), counts.tolist(), names.to_pylist())):
                data.append(mvt.layer(name, ((id_, kind, commands, known[text]) for id_, kind, commands, text in features[a : a + n])))
                held += len(data[-1])
                if len(data) >= 500 or held > 4 << 20:
                    yield made(first)
                    data, first, held = [], k + 1, 0
            if data:
                yield made(first)

    layers = spread.mapInArrow(run, "z int, x int, y int, layer string, data binary, n bigint, filled boolean")
    tiles = layers.groupBy("z", "x", "y").agg(F.array_sort(F.collect_list(F.struct("layer", "data"))).alias("parts"), F.sum("n").alias("n_features"), F.bool_and("filled").alias("filled"))
    if skip_filled:
        tiles = tiles.filter("not filled")
    joined = tiles.select("z", "x", "y", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"])).alias("data"), "n_features")

    def squeeze(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["data"] = [mvt.compressed(bytes(d), compression) for d in frame["data"]]
            yield frame

    return joined.mapInPandas(squeeze, "z int, x int, y int, data binary, n_features bigint")


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """(z, x, y, layer, id, kind, n_parts, attrs) of every feature in encoded tiles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for z, x, y, data in zip(frame["z"], frame["x"], frame["y"], frame["data"]):
                for layer, features in mvt.decode(bytes(data)).items():
                    rows += [(z, x, y, layer, f["id"], f["kind"], len(mvt.parts_of(f["kind"], f["commands"])), {k: str(v) for k, v in f["attrs"].items()}) for f in features]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "id", "kind", "n_parts", "attrs"])

    return tiles.select("z", "x", "y", "data").mapInPandas(run, "z int, x int, y int, layer string, id bigint, kind string, n_parts int, attrs map<string,string>")
