"""Archive and layer statistics, comparison of archives, and the rollups over zooms and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layer_schema(attrs: DataFrame, keys: list[str]) -> DataFrame:
    """Per field: Number, Boolean or String, widened to String where kinds differ, with its zoom range. ``kind`` and ``z`` are columns."""
    widened = F.when(F.min("kind") == F.max("kind"), F.max("kind")).otherwise("String")
    return attrs.groupBy(*keys).agg(widened.alias("kind"), F.min("z").alias("minzoom"), F.max("z").alias("maxzoom"), F.count("*").alias("n_values"))


def tile_layer_stats(attrs: DataFrame) -> DataFrame:
    """Per (tile, layer): features, attribute values, distinct keys and distinct values."""
    return attrs.groupBy("tile_id", "layer").agg(
        F.count_distinct("feature_id").alias("layer_features"), F.count("*").alias("layer_values"), F.count_distinct("field_name").alias("layer_attr_keys"), F.count_distinct("value").alias("layer_attr_values")
    )


def summary(cells: DataFrame, weights: DataFrame | None, size: str = "size") -> DataFrame:
    """Max, count, mean and weighted mean of a size by (zoom, layer), zoom, layer and overall; without any weight the mean stands in."""
    if weights is not None:
        cells = cells.join(weights, "tile_id", "left")
    weight = F.coalesce(F.col("loads"), F.lit(0)) if weights is not None else F.lit(0)
    cells = cells.withColumn("_w", weight.cast("double"))
    grouped = cells.groupingSets([[F.col("z"), F.col("layer")], [F.col("z")], [F.col("layer")], []], F.col("z"), F.col("layer"))
    total = F.sum("_w")
    return grouped.agg(
        F.grouping_id().alias("level"), F.max(size).alias("max_size"), F.count("*").alias("n_tiles"), F.avg(size).alias("mean_size"),
        F.when(total > 0, F.sum(F.col("_w") * F.col(size)) / total).otherwise(F.avg(size)).alias("weighted_size"),
    )


def combined_zooms(cells: DataFrame, zoom_weights: DataFrame, size: str = "size") -> DataFrame:
    """Mean size over all zooms when the zooms are weighted as given and the tiles of a zoom by their loads."""
    per_zoom = cells.groupBy("z").agg((F.sum(F.col("loads") * F.col(size)) / F.sum("loads")).alias("mean_size"))
    joined = per_zoom.join(zoom_weights, "z")
    return joined.agg((F.sum(F.col("mean_size") * F.col("zoom_weight")) / F.sum("zoom_weight")).alias("combined_size"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; the rank filter is applied before the shuffle too."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def rolled_up_loads(tiles: DataFrame, n: int) -> DataFrame:
    """The ``n`` parents (one zoom lower) with the most loads; ties go to the smaller tile."""
    parents = tiles.filter("z > 0").select((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), "loads")
    return parents.groupBy("z", "x", "y").agg(F.sum("loads").alias("loads")).orderBy(F.desc("loads"), "z", "x", "y").limit(n)


def compare(left: DataFrame, right: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Full outer comparison: keys and what differs (``missing_left``, ``missing_right``, ``different``); equal rows are left out."""
    joined = left.select(*keys, F.col(content).alias("_a"), F.lit(True).alias("_in_a")).join(right.select(*keys, F.col(content).alias("_b"), F.lit(True).alias("_in_b")), keys, "full_outer")
    diff = F.when(F.col("_in_a").isNull(), "missing_left").when(F.col("_in_b").isNull(), "missing_right").when(~F.col("_a").eqNullSafe(F.col("_b")), "different")
    return joined.select(*keys, diff.alias("diff")).filter("diff is not null")


def deduplicated(tiles: DataFrame, content: str = "content") -> DataFrame:
    """Tiles with the id of the first tile that has the same content, and that content's number in order of first appearance.

    Hashes are grouped with map-side combination; a hot content becomes one row before its tiles are joined back.
    """
    hashed = tiles.withColumn("hash", F.sha2(F.col(content), 256))
    firsts = hashed.groupBy("hash").agg(F.min("tile_id").alias("first_tile"), F.count("*").alias("copies"), F.max(F.length(content)).alias("length"))
    return hashed.drop(content).join(firsts, "hash")


def offsets(firsts: DataFrame, slices: int = 64) -> DataFrame:
    """Running byte offset of each content in the order of its first tile: sums per range first, then within the range."""
    span = firsts.agg(F.min("first_tile").alias("a"), F.max("first_tile").alias("b"))
    sliced = firsts.withColumn("_a", span.select("a").scalar()).withColumn("_b", span.select("b").scalar())
    sliced = sliced.withColumn("_slice", F.floor((F.col("first_tile") - F.col("_a")) * slices / (F.col("_b") - F.col("_a") + 1)).cast("int"))
    sums = sliced.groupBy("_slice").agg(F.sum("length").alias("_s"))
    before = sums.select("_slice", (F.sum("_s").over(Window.orderBy("_slice")) - F.col("_s")).alias("_before"))  # one row per slice
    inside = F.sum("length").over(Window.partitionBy("_slice").orderBy("first_tile").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return sliced.withColumn("_in", inside).join(before, "_slice").select(*firsts.columns, (F.col("_before") + F.col("_in")).alias("offset"))
