"""Choosing what to read before anything is read: catalogues of items with bounds, hive folders, globs, file footers."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def meets_bounds(west: float, south: float, east: float, north: float) -> Column:
    """Items (minx, miny, maxx, maxy) that meet the bounds; an item without bounds may hold anything and stays."""
    known = F.col("minx").isNotNull() & F.col("miny").isNotNull() & F.col("maxx").isNotNull() & F.col("maxy").isNotNull()
    return ~known | ((F.col("minx") <= east) & (F.col("maxx") >= west) & (F.col("miny") <= north) & (F.col("maxy") >= south))


def catalog_items(root: str, theme: str | None = None, kind: str | None = None, bounds: tuple[float, float, float, float] | None = None) -> list[str]:
    """Data files of a static catalogue (catalog.json, with children and items by ``links``), pruned by theme, type and bounds at each level."""

    def meets(box) -> bool:
        return bounds is None or not box or len(box) < 4 or (box[0] <= bounds[2] and box[2] >= bounds[0] and box[1] <= bounds[3] and box[3] >= bounds[1])

    found, todo = [], [(root, 0)]
    while todo:
        path, depth = todo.pop()
        with open(path, encoding="utf-8") as source:
            node = json.load(source)
        extent = (node.get("extent", {}).get("spatial", {}).get("bbox") or [None])[0]
        if not meets(node.get("bbox") or extent):
            continue
        if wanted := {1: theme, 2: kind}.get(depth):
            if node.get("id") != wanted:
                continue
        here = os.path.dirname(path)
        for asset in (node.get("assets") or {}).values():
            if str(asset.get("href", "")).endswith(".parquet"):
                found.append(os.path.normpath(os.path.join(here, asset["href"])))
        todo += [(os.path.normpath(os.path.join(here, link["href"])), depth + 1) for link in node.get("links", []) if link.get("rel") in ("child", "item")]
    return sorted(found)


def hive_fields(path: str) -> dict[str, str]:
    """The ``k=v`` parts of a path, as text."""
    return dict(part.split("=", 1) for part in path.split("/") if "=" in part)


def read_parquet(spark: SparkSession, paths: list[str] | str, bounds: tuple[float, float, float, float] | None = None, layer_from: str | None = None) -> DataFrame:
    """Parquet files or folders: hive parts become text columns, a ``bbox`` column is compared before rows are read.

    The comparison is on plain nested fields, so it reaches the files' row groups.
    """
    listed = [paths] if isinstance(paths, str) else paths
    files = sorted({f for p in listed for f in (glob.glob(p) if glob.has_magic(p) else [p])})
    before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        df = spark.read.parquet(*files)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", before)
    if bounds and "bbox" in df.columns:
        b = lambda name: F.col(f"bbox.{name}")
        df = df.filter((b("xmin") <= bounds[2]) & (b("xmax") >= bounds[0]) & (b("ymin") <= bounds[3]) & (b("ymax") >= bounds[1]))
    if layer_from and layer_from in df.columns:
        df = df.withColumn("source_layer", F.col(layer_from))
    return df


def geo_metadata(path: str) -> dict:
    """The ``geo`` entry of a Parquet footer with defaults for what is missing: WKB in the first column with a known name."""
    import pyarrow.parquet as pq

    schema = pq.read_schema(path)
    raw = (schema.metadata or {}).get(b"geo")
    names = [n for n in ("geometry", "geom", "wkb_geometry", "wkt", "geojson") if n in schema.names]
    default = {"version": None, "primary_column": names[0] if names else None, "columns": {n: {"encoding": "WKT" if n == "wkt" else "WKB", "geometry_types": []} for n in names}}
    if raw is None:
        return default
    try:
        read = json.loads(raw)
    except ValueError:
        return default
    read.setdefault("primary_column", default["primary_column"])
    read.setdefault("columns", default["columns"])
    for column in read["columns"].values():
        column.setdefault("encoding", "WKB")
        column["geometry_types"] = column.get("geometry_types") or []
    return read


def files_in_bounds(paths: list[str], bounds: tuple[float, float, float, float]) -> list[str]:
    """Files whose footers do not rule out the bounds."""
    kept = []
    for path in paths:
        meta = geo_metadata(path)
        box = (meta["columns"].get(meta["primary_column"]) or {}).get("bbox") if meta["primary_column"] else None
        if box and len(box) in (4, 6):
            w, s, e, n = (*box[:2], *box[len(box) // 2 :][:2])
            if w > bounds[2] or e < bounds[0] or s > bounds[3] or n < bounds[1]:
                continue
        kept.append(path)
    return kept
