"""Readers of feature files: shapefile, GeoPackage and other SQLite tables, GeoJSON, boundary polygons, and tile archives.

The driver only lists what there is (record offsets, row ranges, directories); records are read and decoded by the executors, from a path
that all of them can open.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.kernels import wkb

FEATURES = "source_layer string, id bigint, tags map<string,string>, geom_type string, shape array<array<array<double>>>, minx double, miny double, maxx double, maxy double"
_NAMES = ["source_layer", "id", "tags", "geom_type", "shape", "minx", "miny", "maxx", "maxy"]
CHUNK = 20_000
Bounds = tuple[float, float, float, float]


def _row(layer: str, id_: int, tags: dict, kind: str, parts: list, bounds: Bounds | None) -> tuple | None:
    points = [p for part in parts for p in part]
    if not points:
        return None
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = (min(xs), min(ys), max(xs), max(ys))
    if bounds and (box[0] > bounds[2] or box[2] < bounds[0] or box[1] > bounds[3] or box[3] < bounds[1]):
        return None
    return (layer, id_, {k: str(v) for k, v in tags.items() if v is not None and v != ""}, kind, parts, *box)


def _text(v) -> str | None:
    return None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def _spread(spark: SparkSession, parts: list[tuple], schema: str, run, out: str = FEATURES) -> DataFrame:
    return spark.createDataFrame(parts, schema).repartition(max(1, min(len(parts), 4096))).mapInPandas(run, out)


# ---- shapefile


def _dbf_fields(data: bytes) -> tuple[int, int, list[tuple[str, str, int]]]:
    header, record = struct.unpack_from("<HH", data, 8)
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(data[at + 11]), data[at + 16]))
        at += 32
    return header, record, fields


def _dbf_row(raw: bytes, fields: list[tuple[str, str, int]], encoding: str) -> dict:
    out, at = {}, 1
    for name, kind, size in fields:
        text = raw[at : at + size].decode(encoding, "replace").strip().strip("\0")
        at += size
        if text and not (kind in "NF" and text.startswith("*")):
            out[name] = {"T": "true", "Y": "true", "F": "false", "N": "false"}.get(text.upper()) if kind == "L" else text
    return out


def _shp_shape(raw: bytes) -> tuple[str, list] | None:
    code = struct.unpack_from("<i", raw)[0] % 10
    if code == 0:
        return None
    if code == 1:
        return "point", [[list(struct.unpack_from("<2d", raw, 4))]]
    if code == 8:
        n = struct.unpack_from("<i", raw, 36)[0]
        flat = struct.unpack_from(f"<{2 * n}d", raw, 40)
        return "point", [[[flat[k], flat[k + 1]] for k in range(0, 2 * n, 2)]]
    parts, n = struct.unpack_from("<ii", raw, 36)
    starts = [*struct.unpack_from(f"<{parts}i", raw, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", raw, 44 + 4 * parts)
    points = [[flat[k], flat[k + 1]] for k in range(0, 2 * n, 2)]
    return "line" if code == 3 else "polygon", [points[a:b] for a, b in zip(starts, starts[1:])]


def shapefile(spark: SparkSession, path: str, bounds: Bounds | None = None, projection: str = "EPSG:4326", encoding: str = "utf-8") -> DataFrame:
    """Features of a shapefile, ids from 1. EPSG:3857 is brought to degrees; other projections are an error."""
    if projection not in ("EPSG:4326", "EPSG:3857"):
        raise ValueError(f"projection {projection} is not supported")
    base = os.path.splitext(path)[0]
    with open(base + ".shx", "rb") as source:
        index = source.read()
    n = (len(index) - 100) // 8
    parts = [(base, k, min(n, k + CHUNK)) for k in range(0, n, CHUNK)] or [(base, 0, 0)]
    layer = os.path.basename(base)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, start, end in zip(frame["base"], frame["start"], frame["end"]):
                rows = []
                with open(name + ".shp", "rb") as shp, open(name + ".shx", "rb") as shx, open(name + ".dbf", "rb") as dbf:
                    head = dbf.read(32)
                    head += dbf.read(struct.unpack_from("<H", head, 8)[0] - 32)
                    header, record, fields = _dbf_fields(head)
                    shx.seek(100 + 8 * start)
                    dbf.seek(header + record * start)
                    for k in range(start, end):
                        offset, size = struct.unpack(">ii", shx.read(8))
                        tags = _dbf_row(dbf.read(record), fields, encoding)
                        shp.seek(2 * offset + 8)
                        shape = _shp_shape(shp.read(2 * size))
                        if shape is None:
                            continue
                        kind, points = shape
                        if projection == "EPSG:3857":
                            points = [[_degrees(*p) for p in part] for part in points]
                        if row := _row(layer, k + 1, tags, kind, points, bounds):
                            rows.append(row)
                yield pd.DataFrame(rows, columns=_NAMES)

    return _spread(spark, parts, "base string, start bigint, end bigint", run)


def _degrees(x: float, y: float) -> list[float]:
    import math

    size = 40075016.68557849
    return [x * 360 / size, math.degrees(2 * math.atan(math.exp(2 * math.pi * y / size)) - math.pi / 2)]


# ---- SQLite: GeoPackage and tables with a GEOMETRY column


def _sqlite(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _ranges(db: sqlite3.Connection, table: str) -> list[tuple[int, int]]:
    low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    return [] if low is None else [(k, min(high + 1, k + CHUNK)) for k in range(low, high + 1, CHUNK)]


def geopackage(spark: SparkSession, path: str, layer: str | None = None, bounds: Bounds | None = None) -> DataFrame:
    """All feature tables (or one) of a GeoPackage; the spatial index prunes rows where there is one; an undefined system counts as degrees."""
    db = _sqlite(path)
    try:
        listed = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall()
        parts = []
        for table, column, srs in listed:
            if layer and table != layer:
                continue
            if srs not in (4326, 3857, 0, -1):
                raise ValueError(f"projection {srs} is not supported")
            index = f"rtree_{table}_{column}"
            has_index = bool(db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (index,)).fetchone())
            parts += [(path, table, column, index if has_index and srs != 3857 else "", srs, a, b) for a, b in _ranges(db, table)]
    finally:
        db.close()
    return _tables(spark, parts, bounds)


def sqlite_features(spark: SparkSession, path: str, bounds: Bounds | None = None) -> DataFrame:
    """Every table with a GEOMETRY column of a SQLite file, the table's name as source_layer; rows without geometry are left out."""
    db = _sqlite(path)
    try:
        parts = []
        for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
            columns = [c[1] for c in db.execute(f'PRAGMA table_info("{table}")')]
            column = next((c for c in columns if c.upper() == "GEOMETRY"), None)
            if column:
                parts += [(path, table, column, "", 4326, a, b) for a, b in _ranges(db, table)]
    finally:
        db.close()
    return _tables(spark, parts, bounds)


def _tables(spark: SparkSession, parts: list[tuple], bounds: Bounds | None) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, table, column, index, srs, start, end in frame.itertuples(index=False):
                db, rows = _sqlite(path), []
                where, args = "rowid >= ? AND rowid < ?", [int(start), int(end)]
                if bounds and index:
                    where += f' AND rowid IN (SELECT id FROM "{index}" WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)'
                    args += [bounds[0], bounds[2], bounds[1], bounds[3]]
                cursor = db.execute(f'SELECT rowid AS _rowid, * FROM "{table}" WHERE {where}', args)
                names = [d[0] for d in cursor.description]
                for values in cursor:
                    record = dict(zip(names[1:], values[1:]))
                    data = record.pop(column, None)
                    shape = wkb.from_geopackage(data) if data else None
                    if not shape:
                        continue
                    kind, points = shape
                    if srs == 3857:
                        points = [[_degrees(*p) for p in part] for part in points]
                    tags = {k: _text(v) for k, v in record.items() if not isinstance(v, bytes)}
                    if row := _row(table, values[0], tags, kind, points, bounds):
                        rows.append(row)
                db.close()
                yield pd.DataFrame(rows, columns=_NAMES)

    return _spread(spark, parts, "path string, tab string, col string, idx string, srs int, start bigint, end bigint", run)


# ---- GeoJSON


def geojson(spark: SparkSession, path: str, layer: str | None = None, bounds: Bounds | None = None) -> DataFrame:
    """A Feature, a FeatureCollection, or one feature a line; what cannot be read is left out. Lines are split over tasks."""
    with open(path, encoding="utf-8") as source:
        opening = source.read(1 << 16)
    lines = [x for x in opening.split("\n") if x.strip()]
    by_line = len(lines) > 1 and all(_whole(x) for x in lines[:1])
    texts = spark.read.text(path, wholetext=not by_line)
    name = layer or os.path.splitext(os.path.basename(path))[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["value"]:
                try:
                    top = json.loads(text.strip().lstrip("\x1e"))
                except ValueError:
                    continue
                items = top.get("features") if isinstance(top, dict) and top.get("type") == "FeatureCollection" else [top]
                for item in items or []:
                    try:
                        geometry = item["geometry"]
                        kind, points = wkb.from_geojson(geometry["type"], geometry["coordinates"])
                        tags = {k: _text(v) if not isinstance(v, dict | list | bool) else json.dumps(v) for k, v in (item.get("properties") or {}).items()}
                        id_ = item.get("id")
                        row = _row(name, id_ if isinstance(id_, int) else 0, tags, kind, points, bounds)
                    except (KeyError, TypeError, ValueError, IndexError, AttributeError):
                        continue
                    if row:
                        rows.append(row)
            yield pd.DataFrame(rows, columns=_NAMES)

    return texts.mapInPandas(run, FEATURES)


def _whole(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


# ---- boundary polygons


def poly_file(path: str) -> list[list[list[list[float]]]]:
    """Polygons (rings of [lon, lat]) of a boundary file: sections that open with ``!`` are holes of the section before."""
    polygons: list = []
    with open(path, encoding="utf-8") as source:
        lines = [x.strip() for x in source][1:]
    ring: list | None = None
    hole = False
    for line in lines:
        if line == "END":
            if ring is None:
                break
            if hole and polygons:
                polygons[-1].append(ring)
            else:
                polygons.append([ring])
            ring = None
        elif ring is None:
            ring, hole = [], line.startswith("!")
        elif line:
            ring.append([float(v) for v in line.split()[:2]])
    return polygons


# ---- tile archives

TILES = "z int, x int, y int, data binary"


def mbtiles(spark: SparkSession, path: str) -> DataFrame:
    """All tiles of an MBTiles file, rows counted from the north; plain and deduplicated layouts."""
    db = _sqlite(path)
    try:
        zooms = [z for (z,) in db.execute("SELECT DISTINCT zoom_level FROM tiles ORDER BY 1")]
        parts = []
        for z in zooms:
            low, high = db.execute("SELECT min(tile_column), max(tile_column) FROM tiles WHERE zoom_level = ?", (z,)).fetchone()
            step = max(1, (high - low + 1) // 64)
            parts += [(path, z, k, min(high + 1, k + step)) for k in range(low, high + 1, step)]
    finally:
        db.close()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, z, a, b in frame.itertuples(index=False):
                source = _sqlite(name)
                rows = source.execute("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles WHERE zoom_level = ? AND tile_column >= ? AND tile_column < ?", (int(z), int(a), int(b))).fetchall()
                source.close()
                yield pd.DataFrame([(z, x, (1 << z) - 1 - y, data) for z, x, y, data in rows], columns=["z", "x", "y", "data"])

    return _spread(spark, parts, "path string, z int, a int, b int", run, TILES)


def pmtiles_header(path: str) -> dict:
    from terrane.sinks.archives import HEADER

    with open(path, "rb") as source:
        v = HEADER.unpack(source.read(127))
    names = ["magic", "version", "root_at", "root_size", "meta_at", "meta_size", "leaf_at", "leaf_size", "data_at", "data_size", "n_addressed", "n_entries", "n_contents", "clustered", "inner", "outer", "kind", "minzoom", "maxzoom"]
    return dict(zip(names, v))


def pmtiles(spark: SparkSession, path: str) -> DataFrame:
    """All tiles of a PMTiles file: runs are expanded to tiles, bytes are read by the executors."""
    from terrane.sinks.archives import parse_directory

    head = pmtiles_header(path)
    with open(path, "rb") as source:

        def entries(at: int, size: int) -> list[tuple]:
            source.seek(at)
            found = []
            for entry in parse_directory(source.read(size)):
                found += [entry] if entry[1] else entries(head["leaf_at"] + entry[3], entry[2])
            return found

        listed = entries(head["root_at"], head["root_size"])
    table = spark.createDataFrame([(path, t, run, size, head["data_at"] + at) for t, run, size, at in listed], "path string, tile bigint, run bigint, size bigint, at bigint")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, tile, times, size, at in frame.itertuples(index=False):
                with open(name, "rb") as data:
                    data.seek(at)
                    content = data.read(size)
                rows += [(*hilbert_tile(k), content) for k in range(tile, tile + times)]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "data"])

    return table.repartition(max(1, min(len(listed) // 1000 + 1, 4096))).mapInPandas(run, TILES)


def hilbert_tile(id_: int) -> tuple[int, int, int]:
    """(z, x, y) of a Hilbert id that counts all lower zooms first."""
    z = 0
    while id_ >= 4**z:
        id_ -= 4**z
        z += 1
    x = y = 0
    side = 1
    while side < 1 << z:
        rx = (id_ // 2) & 1
        ry = (id_ ^ rx) & 1
        if ry == 0:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y = x + side * rx, y + side * ry
        id_ //= 4
        side *= 2
    return z, x, y


def tile_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles of a {z}/{x}/{y} tree of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    part = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.\w+$", k).cast("int")
    return files.select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), F.col("content").alias("data"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of an archive, by the path's ending."""
    if path.endswith(".mbtiles"):
        return mbtiles(spark, path)
    if path.endswith(".pmtiles"):
        return pmtiles(spark, path)
    return tile_tree(spark, path)


READERS = {"shapefile": shapefile, "geopackage": geopackage, "natural_earth": sqlite_features, "geojson": geojson}


def features(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Features of a source by its type; osm and parquet have readers of their own."""
    if kind not in READERS:
        raise ValueError(f"unknown source type {kind}")
    return READERS[kind](spark, path, **options)
