"""Merging features that agree in their attributes, within a tile, and places along lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.streams import kernel_partitions, over_groups


def by_attributes(features: DataFrame, keys: list[str], attrs: str, id_: str, order: Column) -> DataFrame:
    """(keys, attrs, n, first_id, merged_id): groups of equal attributes; a group of several gets the first id with its type digit cleared."""
    grouped = features.groupBy(*keys, attrs).agg(F.count("*").alias("n"), F.min_by(id_, order).alias("first_id"))
    return grouped.withColumn("merged_id", F.when(F.col("n") > 1, F.floor(F.col("first_id") / 10) * 10).otherwise(F.col("first_id")))


def point_along(lines: DataFrame, share: float) -> DataFrame:
    """The place at a share of the length of each line, given as ``seg`` array<struct<x, y, x2, y2, len>>; all inside generated code."""
    if not 0 <= share <= 1:
        raise ValueError("the share must be between 0 and 1")
    rest = [c for c in lines.columns if c != "seg"]
    goal = F.aggregate("seg", F.lit(0.0), lambda a, s: a + s["len"]) * share
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))

    def step(a: Column, s: Column) -> Column:
        hit = a["lon"].isNull() & (s["len"] > 0) & (a["run"] + s["len"] >= F.col("goal"))
        t = (F.col("goal") - a["run"]) / F.when(s["len"] > 0, s["len"])
        return F.struct((a["run"] + s["len"]).alias("run"), F.when(hit, s["x"] + (s["x2"] - s["x"]) * t).otherwise(a["lon"]).alias("lon"), F.when(hit, s["y"] + (s["y2"] - s["y"]) * t).otherwise(a["lat"]).alias("lat"))

    return lines.withColumn("goal", goal).withColumn("at", F.aggregate("seg", start, step)).filter("at.lon is not null").select(*rest, "at.lon", "at.lat")


def merge_in_tiles(features: DataFrame, keys: list[str], kernel: Callable[[list], list], partitions: int | None = None) -> DataFrame:
    """Run a merge kernel over the lines of each (keys, attrs) group: ``line`` array<array<double>> in, merged lines out.

    The attributes are part of the group's key, so a heavy tile is spread over as many tasks as it has attribute sets.
    """
    types = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    out = ", ".join(f"{k} {types[k]}" for k in [*keys, "attrs"]) + ", id bigint, line array<array<double>>"

    def run(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        merged = kernel([[tuple(p) for p in line] for line in group["line"]])
        id_ = int(group["id"].min())
        if len(group) > 1:
            id_ = id_ // 10 * 10
        head = {k: group[k].iloc[0] for k in [*keys, "attrs"]}
        if merged:
            yield pd.DataFrame([{**head, "id": id_, "line": [list(p) for p in line]} for line in merged])

    return over_groups(features.select(*keys, "attrs", "id", "line"), [*keys, "attrs"], run, out, partitions or kernel_partitions(features))
