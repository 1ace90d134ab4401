"""Map projection, tile numbering and measuring as column expressions: all of it stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
EQUATOR_M = 40075016.68557849
MAX_LAT = math.degrees(2 * math.atan(math.exp(math.pi)) - math.pi / 2)
MAX_ZOOM = 16


def world_x(lon: Column) -> Column:
    """Longitude to the web-mercator world, 0 to 1."""
    return (lon + 180.0) / 360.0


def world_y(lat: Column) -> Column:
    """Latitude to the web-mercator world, 0 (north) to 1; -0.1 and 1.1 beyond its ends."""
    s = F.sin(F.radians(lat))
    inside = F.lit(0.5) - F.ln((1 + s) / (1 - s)) * (0.25 / math.pi)
    return F.when(lat > MAX_LAT, -0.1).when(lat < -MAX_LAT, 1.1).otherwise(inside)


def world_lon(x: Column) -> Column:
    return x * 360.0 - 180.0


def world_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(math.pi - 2 * math.pi * y)) * 2) - 90.0


def tile_column(world: Column, zoom: Column) -> Column:
    """Number of the tile along one axis."""
    return F.floor(world * F.pow(F.lit(2.0), zoom)).cast("bigint")


def tile_start(zoom: Column) -> Column:
    """Number of tiles in all lower zooms: the first id of a zoom."""
    return F.floor((F.pow(F.lit(4.0), zoom) - 1) / 3).cast("bigint")


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Dense id in the order zoom, column ascending, row from south to north."""
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), z.cast("int"))
    return tile_start(z) + x * side + (side - 1 - y)


def tile_from_id(id_: Column) -> Column:
    """struct<z, x, y> of a dense id."""
    z = F.floor(F.log2((id_ * 3 + 1).cast("double")) / 2).cast("int")
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), z)
    rest = id_ - tile_start(z)
    x = F.floor(rest / side).cast("bigint")
    return F.struct(z.alias("z"), x.alias("x"), (side - 1 - (rest - x * side)).alias("y"))


def hilbert_index(level: int, x: Column, y: Column) -> Column:
    """Position of cell (x, y) on the Hilbert curve over a 2**level square.

    One fold over the bits, highest first: written out as nested expressions it would double with every bit.
    """
    big = lambda v: F.lit(v).cast("bigint")
    if level == 0:
        return big(0)
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), big(0).alias("d"))

    def step(acc: Column, side: Column) -> Column:
        rx, ry = (acc["x"].bitwiseAND(side) != 0).cast("bigint"), (acc["y"].bitwiseAND(side) != 0).cast("bigint")
        low_x, low_y = acc["x"].bitwiseAND(side - 1), acc["y"].bitwiseAND(side - 1)
        flip = (ry == 0) & (rx == 1)
        turned_x, turned_y = F.when(flip, side - 1 - low_x).otherwise(low_x), F.when(flip, side - 1 - low_y).otherwise(low_y)
        return F.struct(
            F.when(ry == 0, turned_y).otherwise(turned_x).alias("x"), F.when(ry == 0, turned_x).otherwise(turned_y).alias("y"), (acc["d"] + side * side * (rx * 3).bitwiseXOR(ry)).alias("d")
        )

    return F.aggregate(F.array(*[big(1 << k) for k in reversed(range(level))]), start, step, lambda acc: acc["d"])


def hilbert_sql(level: int, x: str, y: str) -> str:
    """The same position as an SQL expression over a struct folded through ``list_reduce``; used by the SQL twins."""
    start = f"{{'x': CAST({x} AS BIGINT), 'y': CAST({y} AS BIGINT), 'd': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT)}}"
    steps = ", ".join(f"{{'x': CAST(0 AS BIGINT), 'y': CAST(0 AS BIGINT), 'd': CAST(0 AS BIGINT), 's': CAST({1 << k} AS BIGINT)}}" for k in reversed(range(level)))
    rx, ry = "((a.x // b.s) % 2)", "((a.y // b.s) % 2)"
    lx, ly = "(a.x % b.s)", "(a.y % b.s)"
    tx = f"(CASE WHEN {ry} = 0 AND {rx} = 1 THEN b.s - 1 - {lx} ELSE {lx} END)"
    ty = f"(CASE WHEN {ry} = 0 AND {rx} = 1 THEN b.s - 1 - {ly} ELSE {ly} END)"
    step = f"{{'x': CASE WHEN {ry} = 0 THEN {ty} ELSE {tx} END, 'y': CASE WHEN {ry} = 0 THEN {tx} ELSE {ty} END, 'd': a.d + b.s * b.s * xor(3 * {rx}, {ry}), 's': b.s}}"
    return f"list_reduce(list_prepend({start}, [{steps}]), lambda a, b: {step}).d"


def pack_location(lon: Column, lat: Column) -> Column:
    """Both world coordinates in one BIGINT, 31 bits each."""
    scale = float((1 << 31) - 1)
    x, y = F.floor(world_x(lon) * scale).cast("bigint"), F.floor(world_y(lat) * scale).cast("bigint")
    return F.shiftleft(x, 32).bitwiseOR(y.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def unpack_x(packed: Column) -> Column:
    return F.shiftright(packed, 32) / float((1 << 31) - 1)


def unpack_y(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) / float((1 << 31) - 1)


def metres_per_pixel(zoom: Column) -> Column:
    """At the equator, with 256 pixels a tile."""
    return F.lit(EQUATOR_M) / F.pow(F.lit(2.0), zoom + 8)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h))) * (2 * EARTH_RADIUS_M)  # null where a coordinate is


def zoom_of_bounds(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The zoom at which a world box fits into one tile."""
    edge = F.greatest(maxx - minx, maxy - miny)
    return F.greatest(F.lit(0.0), -F.log2(edge))


def min_zoom_for_pixels(world_size: Column, pixels: float) -> Column:
    """The first zoom at which something of that world size covers so many pixels, 0 to 16."""
    return F.least(F.greatest(F.ceil(F.log2(F.lit(float(pixels)) / (world_size * 256.0))), F.lit(0)), F.lit(MAX_ZOOM)).cast("int")


def pixel_size(world_size: Column, zoom: Column) -> Column:
    return world_size * 256.0 * F.pow(F.lit(2.0), zoom)


def zigzag(v: Column) -> Column:
    """32-bit zig-zag code of an INT."""
    return F.call_function("shiftleft", v, F.lit(1)).bitwiseXOR(F.shiftright(v, 31))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1))))


# fixed values: how many of each unit one metre (square metre) has; the two zoom-0 units are fractions of the world's width
LENGTH_UNITS = {
    "m": 1.0, "ft": 3.28084, "yd": 1.09361, "nmi": 1 / 1852.0, "mi": 0.000621371, "km": 0.001, "z0_px": 1 / 256, "z0_tile": 1.0,
}
AREA_UNITS = {
    "m2": 1.0, "ft2": 3.28084**2, "yd2": 1.09361**2, "nmi2": 1 / 1852.0**2, "mi2": 0.000621371**2, "km2": 1e-6, "are": 0.01, "ha": 0.0001, "ac": 0.000247105, "z0_px2": 1 / 256**2, "z0_tile2": 1.0,
}


def in_unit(metres: Column, unit: str) -> Column:
    """A length in metres, or in world widths for the zoom-0 units, in another unit."""
    return metres * LENGTH_UNITS[unit]


def level_of(value: Column, low: float, high: float, levels: int) -> Column:
    """Which of ``levels`` equal steps between low and high the value falls into."""
    return F.least(F.lit(levels - 1), F.floor((value - low) / (high - low) * levels).cast("int"))


def log_level_of(value: Column, low: float, high: float, levels: int) -> Column:
    return level_of(F.ln(value), math.log(low), math.log(high), levels)


def wrap01(x: Column) -> Column:
    """Positive remainder of 1."""
    return F.pmod(x, F.lit(1.0))


def feature_id(osm_id: Column, kind: Column, multiplier: int = 10) -> Column:
    """id * multiplier + {0 other, 1 node, 2 way, 3 relation}; a multiplier below 4 leaves the id alone."""
    if multiplier < 4:
        return osm_id
    return osm_id * multiplier + F.when(kind == "node", 1).when(kind == "way", 2).when(kind == "relation", 3).otherwise(0)


def label_grid_id(x: Column, y: Column, size: Column) -> Column:
    """Id of the square of a grid that holds a tile-unit position; null where the squares are below 1/4096 of a tile."""
    row = F.floor(y / size).cast("bigint")
    return F.when(size >= 1 / 4096, F.shiftleft(F.floor(x / size).cast("bigint"), 32).bitwiseOR(row.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))))


def outcode(x: Column, y: Column, low: float, high: float) -> Column:
    """Cohen-Sutherland sides of a box: 1 left, 2 right, 4 above, 8 below."""
    return F.when(x < low, 1).when(x > high, 2).otherwise(0) + F.when(y < low, 4).when(y > high, 8).otherwise(0)


def to_mercator_m(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return lon * (EQUATOR_M / 360.0), (0.5 - world_y(lat)) * EQUATOR_M


def from_mercator_m(x: Column, y: Column) -> tuple[Column, Column]:
    return x * (360.0 / EQUATOR_M), world_lat(0.5 - y / EQUATOR_M)
