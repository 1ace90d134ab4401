"""From features to tiles: the explosions, the per-tile limits and the orders. All of it is column expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo

SORT_KEY_BITS = 22
SORT_KEY_MIN = -(1 << (SORT_KEY_BITS - 1))
SORT_KEY_MAX = (1 << (SORT_KEY_BITS - 1)) - 1


def explode_zooms(df: DataFrame, low: Column | int, high: Column | int) -> DataFrame:
    """One row per zoom from ``low`` to ``high``; none where low is above high."""
    low, high = (F.lit(v) if isinstance(v, int) else v for v in (low, high))
    zooms = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))
    return df.withColumn("z", F.explode(zooms))


def point_tiles(df: DataFrame, buffer_px: Column | float, x: str = "wx", y: str = "wy") -> DataFrame:
    """One row per tile whose buffered square holds the point (world x, y at zoom z): tx, ty and the place in it, px and py.

    Columns wrap around the antimeridian, rows stop at the world's ends.
    """
    buffer = (F.lit(float(buffer_px)) if not isinstance(buffer_px, Column) else buffer_px) / 256.0 + 0.1 / 4096
    side = F.pow(F.lit(2.0), F.col("z"))
    df = df.withColumn("_x", F.col(x) * side).withColumn("_y", F.col(y) * side).withColumn("_n", side.cast("bigint"))
    first_x, last_x = F.floor(F.col("_x") - buffer).cast("bigint"), F.floor(F.col("_x") + buffer).cast("bigint")
    first_y = F.greatest(F.floor(F.col("_y") - buffer).cast("bigint"), F.lit(0))
    last_y = F.least(F.floor(F.col("_y") + buffer).cast("bigint"), F.col("_n") - 1)
    rows = F.when(first_y <= last_y, F.sequence(first_y, last_y))
    df = df.withColumn("_tx", F.explode(F.sequence(first_x, last_x))).withColumn("ty", F.explode(rows))
    return df.select(*[c for c in df.columns if not c.startswith("_") and c != "ty"], F.pmod("_tx", "_n").alias("tx"), "ty", ((F.col("_x") - F.col("_tx")) * 256).alias("px"), ((F.col("_y") - F.col("ty")) * 256).alias("py"))


def box_tiles(df: DataFrame, minx: str = "minx", miny: str = "miny", maxx: str = "maxx", maxy: str = "maxy") -> DataFrame:
    """One row per tile that a world box meets at zoom z."""
    side = F.pow(F.lit(2.0), F.col("z"))
    clip = lambda v: F.least(F.greatest(F.floor(v * side), F.lit(0)), side - 1).cast("bigint")
    return df.withColumn("tx", F.explode(F.sequence(clip(F.col(minx)), clip(F.col(maxx))))).withColumn("ty", F.explode(F.sequence(clip(F.col(miny)), clip(F.col(maxy)))))


def tile_ranges(minx: float, miny: float, maxx: float, maxy: float, zooms: range) -> list[tuple[int, int, int, int, int]]:
    """(z, first column, first row, end column, end row) of a world box per zoom, ends exclusive."""
    found = []
    for z in zooms:
        n = 1 << z
        clip = lambda v, n=n: max(0, min(n, v))
        found.append((z, clip(int(minx * n // 1)), clip(int(miny * n // 1)), clip(-int(-maxx * n // 1)), clip(-int(-maxy * n // 1))))
    return found


def in_tile_ranges(z: Column, x: Column, y: Column, ranges: list[tuple[int, int, int, int, int]]) -> Column:
    inside = F.lit(False)
    for zoom, x0, y0, x1, y1 in ranges:
        inside = inside | ((z == zoom) & (x >= x0) & (x < x1) & (y >= y0) & (y < y1))
    return inside


def within_buffer(px: Column, py: Column, buffer_px: float) -> Column:
    """The point filter of merged layers; an infinite buffer keeps everything."""
    if buffer_px == float("inf"):
        return F.lit(True)
    return px.between(-buffer_px, 256 + buffer_px) & py.between(-buffer_px, 256 + buffer_px)


def limit_per_cell(df: DataFrame, cell: str, limit: Column | int, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first ``limit`` rows per (keys, cell) in the full order given; rows without a cell and limits below 1 keep everything.

    Only rows that belong to a cell meet the window, so ungrouped rows never form one heavy group. ``row_number() <= n`` on an
    outermost filter lets the engine cut each group map-side before the shuffle.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    grouped = F.col(cell).isNotNull() & (limit >= 1)
    ranked = df.filter(grouped).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank").unionByName(df.filter(~F.coalesce(grouped, F.lit(False))))


class SortKey:
    """A sort key in one signed 22-bit integer, most significant part first.

    Reversed ranges subtract the value from ``start``, so they order right only where the other end is 0; native multi-column ordering
    has no such limit, this class is for parity of the numbers.
    """

    def __init__(self):
        self.value, self.levels = F.lit(0).cast("bigint"), 1

    def _then(self, level: Column, levels: int) -> SortKey:
        self.levels *= levels
        if self.levels > 1 << SORT_KEY_BITS:
            raise ValueError(f"too many possible values: {self.levels}")
        self.value = self.value * levels + level.cast("bigint")
        return self

    def ints(self, value: Column, start: int, end: int) -> SortKey:
        if start > end:
            return self.ints(F.lit(start) - value, end, start)
        return self._then(F.least(F.greatest(value, F.lit(start)), F.lit(end)) - start, end + 1 - start)

    def doubles(self, value: Column, start: float, end: float, levels: int) -> SortKey:
        if start > end:
            return self.doubles(F.lit(start) - value, end, start, levels)
        held = F.least(F.greatest(value, F.lit(float(start))), F.lit(float(end)))
        return self._then(geo.level_of(held, start, end, levels), levels)

    def logs(self, value: Column, start: float, end: float, levels: int) -> SortKey:
        if start > end:
            return self.logs(F.lit(float(start)) / value, end, start, levels)
        held = F.least(F.greatest(value, F.lit(float(start))), F.lit(float(end)))
        return self._then(geo.log_level_of(held, start, end, levels), levels)

    def trues_first(self, value: Column) -> SortKey:
        return self._then(F.when(value, 0).otherwise(1), 2)

    def trues_last(self, value: Column) -> SortKey:
        return self._then(F.when(value, 1).otherwise(0), 2)

    def get(self) -> Column:
        return (self.value + SORT_KEY_MIN).cast("int")


def descending(sort_key: Column) -> Column:
    return F.lit(SORT_KEY_MAX + SORT_KEY_MIN) - sort_key


def point_commands(px: Column, py: Column, scale: float = 16.0) -> Column:
    """Vector-tile commands of one point: move-to, then the zig-zagged grid place (4096 units a tile)."""
    grid = lambda v: geo.zigzag(F.floor(v * scale + 0.5).cast("int"))
    return F.array(F.lit(9), grid(px), grid(py))


def runs(df: DataFrame, key: str, same: list[str], bucket: Column | None = None) -> DataFrame:
    """Gaps and islands: consecutive values of ``key`` with equal ``same`` columns become one row (first, length).

    The rows of one island share ``key - rank``; the rank is taken per value of ``same``, so the window is partitioned.
    """
    rank = F.row_number().over(Window.partitionBy(*same).orderBy(key))
    return df.withColumn("_island", F.col(key) - rank).groupBy(*same, "_island").agg(F.min(key).alias("first"), F.count("*").alias("length")).drop("_island")


def line_overlay(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlay of interval overrides (start_at, end_at, priority, attr): per key, pieces between neighbouring break points with the
    attributes of every interval over them, in the order of priority; equal neighbours are joined."""
    points = ranges.select(*keys, F.explode(F.array("start_at", "end_at", F.lit(0.0), F.lit(1.0))).alias("at")).distinct()
    by_key = Window.partitionBy(*keys).orderBy("at")
    pieces = points.withColumn("until", F.lead("at").over(by_key)).filter("until is not null")
    covered = pieces.join(ranges, keys, "left").withColumn("hit", (F.col("start_at") <= F.col("at")) & (F.col("end_at") >= F.col("until")))
    told = covered.groupBy(*keys, "at", "until").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("priority", "attr")))), lambda x: x["attr"]), ",").alias("attrs"))
    by_piece = Window.partitionBy(*keys).orderBy("at")
    marked = told.withColumn("_new", F.when(F.col("attrs").eqNullSafe(F.lag("attrs").over(by_piece)) & (F.lag("until").over(by_piece) == F.col("at")), 0).otherwise(1))
    grouped = marked.withColumn("_run", F.sum("_new").over(by_piece))
    return grouped.groupBy(*keys, "_run").agg(F.min("at").alias("start_at"), F.max("until").alias("end_at"), F.first("attrs").alias("attrs")).drop("_run")
