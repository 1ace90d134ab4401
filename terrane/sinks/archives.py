"""Tile archives: the tables behind each format as plans, and the writers that turn sorted tiles into files.

Formats of many files (tree, CSV, TSV, JSON lines, length-delimited stream) are written by the executors. MBTiles and PMTiles are one file
each by definition: their rows are sorted in parallel and streamed to one writer, which never holds more than one partition.
"""

from __future__ import annotations

import gzip
import json
import os
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo


def compact(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tile_id, data_id) and (data_id, content) of tiles (tile_id, content): equal contents are kept once, numbered by first appearance."""
    from terrane.operators.stats import offsets

    hashed = tiles.withColumn("hash", F.sha2("content", 256))
    firsts = hashed.groupBy("hash").agg(F.min("tile_id").alias("first_tile"), F.first("content").alias("content"), F.lit(1).alias("length"))
    numbered = offsets(firsts.select("hash", "first_tile", "length")).select("hash", F.col("offset").alias("data_id"))
    return hashed.join(numbered, "hash").select("tile_id", "data_id"), firsts.join(numbered, "hash").select("data_id", "content")


def tile_path(scheme: str, z: str = "z", x: str = "x", y: str = "y") -> Column:
    """A path from {z}, {x}, {y}, and {xs}, {ys} for two folders of three digits each."""
    safe = lambda c: F.concat(F.lpad(F.floor(F.col(c) / 1000).cast("string"), 3, "0"), F.lit("/"), F.lpad((F.col(c) % 1000).cast("string"), 3, "0"))
    parts, rest = [], scheme
    columns = {"{z}": F.col(z).cast("string"), "{x}": F.col(x).cast("string"), "{y}": F.col(y).cast("string"), "{xs}": safe(x), "{ys}": safe(y)}
    while rest:
        found = min((k for k in columns if k in rest), key=rest.index, default=None)
        if found is None:
            parts.append(F.lit(rest))
            break
        head, rest = rest.split(found, 1)
        if head:
            parts.append(F.lit(head))
        parts.append(columns[found])
    return F.concat(*parts)


def encoded(data: Column, how: str) -> Column:
    if how == "base64":
        return F.translate(F.base64(data), "\r\n", "")  # without the line breaks of MIME
    if how == "hex":
        return F.lower(F.hex(data))
    raise ValueError(f"unknown encoding {how}")


def write_delimited(tiles: DataFrame, path: str, separator: str = ",", how: str = "base64") -> None:
    """x, y, z, data rows as CSV or, with a tab, TSV."""
    tiles.select("x", "y", "z", encoded(F.col("data"), how).alias("data")).write.option("sep", separator).mode("overwrite").csv(path)


def json_entries(tiles: DataFrame, keys: list[str], metadata: dict) -> DataFrame:
    """One JSON text per line: an opening entry, one per tile, and a closing one with the metadata."""
    spark = tiles.sparkSession
    rows = tiles.select(F.to_json(F.struct(F.lit("tile").alias("type"), *keys, encoded(F.col("data"), "base64").alias("encodedData"))).alias("line"))
    ends = [(json.dumps({"type": "initialization"}, separators=(",", ":")),), (json.dumps({"type": "finish", "metadata": metadata}, separators=(",", ":")),)]
    return rows.unionByName(spark.createDataFrame(ends, "line string"))


def write_json_lines(tiles: DataFrame, path: str, metadata: dict) -> None:
    json_entries(tiles, ["x", "y", "z"], metadata).write.mode("overwrite").text(path)


def write_tree(tiles: DataFrame, folder: str, scheme: str = "{z}/{x}/{y}.pbf") -> int:
    """Each tile in a file of its own below a folder that all executors share; returns how many were written."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["data"]):
                target = os.path.join(folder, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target + ".part", "wb") as out:  # a task that is run again replaces its own files
                    out.write(data)
                os.replace(target + ".part", target)
            yield pd.DataFrame({"n": [len(frame)]})

    return tiles.select(tile_path(scheme).alias("path"), "data").mapInPandas(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def in_tile_order(tiles: DataFrame, order: str = "tms") -> DataFrame:
    """Tiles sorted over all partitions: by dense id, or by the Hilbert curve within each zoom."""
    if order == "tms":
        key = geo.tile_id(F.col("z"), F.col("x").cast("bigint"), F.col("y").cast("bigint"))
    else:
        key = hilbert_id(F.col("z"), F.col("x").cast("bigint"), F.col("y").cast("bigint"))
    return tiles.withColumn("tile_id", key).repartitionByRange("tile_id").sortWithinPartitions("tile_id")


def hilbert_id(z: Column, x: Column, y: Column) -> Column:
    """Id along the Hilbert curve of each zoom, all lower zooms first."""
    level = F.when(z == 0, F.lit(0).cast("bigint"))
    for zoom in range(1, geo.MAX_ZOOM + 1):
        level = level.when(z == zoom, geo.hilbert_index(zoom, x, y))
    return geo.tile_start(z) + level


def write_mbtiles(tiles: DataFrame, path: str, metadata: dict, deduplicate: bool = False) -> None:
    """SQLite archive with rows counted from the south; ``deduplicate`` keeps equal contents once behind a view."""
    db = sqlite3.connect(path)
    try:
        db.execute("CREATE TABLE metadata (name TEXT PRIMARY KEY, value TEXT)")
        db.executemany("INSERT INTO metadata VALUES (?, ?)", [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in metadata.items()])
        if deduplicate:
            db.execute("CREATE TABLE tiles_shallow (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data_id INTEGER, PRIMARY KEY (zoom_level, tile_column, tile_row)) WITHOUT ROWID")
            db.execute("CREATE TABLE tiles_data (tile_data_id INTEGER PRIMARY KEY, tile_data BLOB)")
            db.execute("CREATE VIEW tiles AS SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles_shallow JOIN tiles_data USING (tile_data_id)")
        else:
            db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB, PRIMARY KEY (zoom_level, tile_column, tile_row))")
        seen: dict[bytes, int] = {}
        ordered = in_tile_order(tiles.withColumn("digest", F.unhex(F.sha2("data", 256))))
        for row in ordered.select("z", "x", "y", "data", "digest").toLocalIterator():
            south = (1 << row["z"]) - 1 - row["y"]
            if not deduplicate:
                db.execute("INSERT INTO tiles VALUES (?, ?, ?, ?)", (row["z"], row["x"], south, bytes(row["data"])))
                continue
            digest = bytes(row["digest"])
            number = seen.get(digest)
            if number is None:
                number = seen[digest] = len(seen)
                db.execute("INSERT INTO tiles_data VALUES (?, ?)", (number, bytes(row["data"])))
            db.execute("INSERT INTO tiles_shallow VALUES (?, ?, ?, ?)", (row["z"], row["x"], south, number))
        db.commit()
    finally:
        db.close()


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def directory_bytes(entries: list[tuple[int, int, int, int]]) -> bytes:
    """PMTiles directory of (tile id, run length, byte length, offset): columns of varints, gzipped."""
    out = [varint(len(entries))]
    last = 0
    for tile, _, _, _ in entries:
        out.append(varint(tile - last))
        last = tile
    out += [varint(run) for _, run, _, _ in entries]
    out += [varint(length) for _, _, length, _ in entries]
    for k, (_, _, _, offset) in enumerate(entries):
        joined = k > 0 and offset == entries[k - 1][3] + entries[k - 1][2]
        out.append(varint(0 if joined else offset + 1))
    return gzip.compress(b"".join(out), mtime=0)


def parse_directory(data: bytes) -> list[tuple[int, int, int, int]]:
    data = gzip.decompress(data)
    n, at = read_varint(data, 0)
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            value, at = read_varint(data, at)
            column.append(value)
        columns.append(column)
    entries, tile, end = [], 0, 0
    for k in range(n):
        tile += columns[0][k]
        offset = columns[3][k] - 1 if columns[3][k] else end
        end = offset + columns[2][k]
        entries.append((tile, columns[1][k], columns[2][k], offset))
    return entries


ROOT_BYTES = 16_384 - 127
HEADER = struct.Struct("<7sB11Q6BiiiiBii")


def write_pmtiles(tiles: DataFrame, path: str, metadata: dict, bounds: tuple[float, float, float, float] = (-180.0, -85.0, 180.0, 85.0), leaf_entries: int = 4096) -> None:
    """One PMTiles (version 3) file: tiles on the Hilbert curve, equal contents once, equal neighbours as one run."""
    entries: list[list[int]] = []
    seen: dict[bytes, tuple[int, int]] = {}
    data_path, size, addressed, zooms = path + ".data", 0, 0, set()
    with open(data_path, "wb") as data:
        ordered = in_tile_order(tiles.withColumn("digest", F.unhex(F.sha2("data", 256))), "hilbert")
        for row in ordered.select("tile_id", "z", "data", "digest").toLocalIterator():
            digest = bytes(row["digest"])
            addressed += 1
            zooms.add(row["z"])
            if digest not in seen:
                seen[digest] = (size, len(row["data"]))
                data.write(row["data"])
                size += len(row["data"])
            offset, length = seen[digest]
            if entries and entries[-1][3] == offset and entries[-1][0] + entries[-1][1] == row["tile_id"]:
                entries[-1][1] += 1
            else:
                entries.append([row["tile_id"], 1, length, offset])
    whole = [tuple(e) for e in entries]
    root, leaves = directory_bytes(whole), b""
    while len(root) > ROOT_BYTES:
        leaves, tops = b"", []
        for start in range(0, len(whole), leaf_entries):
            leaf = directory_bytes(whole[start : start + leaf_entries])
            tops.append((whole[start][0], 0, len(leaf), len(leaves)))
            leaves += leaf
        root, leaf_entries = directory_bytes(tops), leaf_entries * 2
    info = gzip.compress(json.dumps(metadata).encode(), mtime=0)
    at = [127, 127 + len(root)]
    at += [at[1] + len(info)]
    at += [at[2] + len(leaves)]
    e7 = lambda v: int(round(v * 1e7))
    low, high = (min(zooms), max(zooms)) if zooms else (0, 0)
    header = HEADER.pack(
        b"PMTiles", 3, at[0], len(root), at[1], len(info), at[2], len(leaves), at[3], size, addressed, len(entries), len(seen), 1, 2, 2, 1, low, high,
        *map(e7, bounds), low, e7((bounds[0] + bounds[2]) / 2), e7((bounds[1] + bounds[3]) / 2),
    )
    with open(path, "wb") as out:
        out.write(header + root + info + leaves)
        with open(data_path, "rb") as data:
            while block := data.read(1 << 20):
                out.write(block)
    os.remove(data_path)


def delimited_message(z: int, x: int, y: int, data: bytes) -> bytes:
    """A length-delimited protobuf entry: field 1 holds the tile (x 1, y 2, z 3, data 4)."""
    tile = b"\x08" + varint(x) + b"\x10" + varint(y) + b"\x18" + varint(z) + b"\x22" + varint(len(data)) + data
    entry = b"\x0a" + varint(len(tile)) + tile
    return varint(len(entry)) + entry


def write_messages(tiles: DataFrame, folder: str) -> int:
    """Length-delimited entries, one file per task in a folder that all executors share."""
    os.makedirs(folder, exist_ok=True)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n, target = 0, os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.pb")
        with open(target + ".part", "wb") as out:
            for frame in frames:
                for z, x, y, data in zip(frame["z"], frame["x"], frame["y"], frame["data"]):
                    out.write(delimited_message(int(z), int(x), int(y), data))
                n += len(frame)
        os.replace(target + ".part", target)
        yield pd.DataFrame({"n": [n]})

    return tiles.select("z", "x", "y", "data").mapInPandas(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_layer_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_tile_weights(weights: DataFrame, path: str) -> None:
    in_tile_order(weights).select("z", "x", "y", "loads").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def archive_metadata(name: str, bounds: tuple[float, float, float, float], layers: DataFrame | None = None, **overrides) -> dict:
    """Metadata of an archive: bounds, centre and the declared layers (id, fields, minzoom, maxzoom), with overrides last."""
    w, s, e, n = bounds
    made = {"name": name, "format": "pbf", "bounds": f"{w:g},{s:g},{e:g},{n:g}", "center": f"{(w + e) / 2:g},{(s + n) / 2:g},0"}
    if layers is not None:
        rows = layers.select("id", "fields", "minzoom", "maxzoom").orderBy("id").collect()  # the layers of one map
        made["vector_layers"] = [{"id": r["id"], "fields": dict(r["fields"] or {}), "minzoom": r["minzoom"], "maxzoom": r["maxzoom"]} for r in rows]
    return made | overrides


WRITERS = {
    "mbtiles": write_mbtiles,
    "pmtiles": write_pmtiles,
    "csv": lambda tiles, path, metadata: write_delimited(tiles, path),
    "tsv": lambda tiles, path, metadata: write_delimited(tiles, path, "\t"),
    "json": write_json_lines,
    "files": lambda tiles, path, metadata: write_tree(tiles, path),
    "pb": lambda tiles, path, metadata: write_messages(tiles, path),
}


def write(tiles: DataFrame, path: str, metadata: dict | None = None, kind: str | None = None) -> None:
    """Write tiles (z, x, y, data) in the format given or named by the path's ending; a folder without one gets a tree of files."""
    ending = os.path.splitext(path)[1].lstrip(".")
    chosen = kind or (ending if ending in WRITERS else "files")
    if chosen not in WRITERS:
        raise ValueError(f"unknown format {chosen}")
    WRITERS[chosen](tiles, path, metadata or {})
