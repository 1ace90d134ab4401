"""Values that depend on the zoom, and names in several languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_max_zoom(z: Column, thresholds: dict[int, float]) -> Column:
    """The value of the lowest threshold that is not below the zoom; null above all of them."""
    result = F.lit(None).cast("double")
    for zoom in sorted(thresholds, reverse=True):
        result = F.when(z <= zoom, F.lit(thresholds[zoom])).otherwise(result)
    return result


def from_zoom(z: Column, start: int, value: Column) -> Column:
    return F.when(z >= start, value)


def in_zooms(z: Column, low: int, high: int, value: Column) -> Column:
    return F.when(z.between(low, high), value)


def translations(providers: list[Column], languages: list[str]) -> Column:
    """name:xx of the languages asked for; earlier providers win, empty names do not count."""
    wanted = F.array(*[F.lit(f"name:{x}") for x in languages])
    result = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    for provider in providers:
        fresh = F.map_filter(provider, lambda k, v: F.array_contains(wanted, k) & v.isNotNull() & (v != "") & ~F.map_contains_key(result, k))
        result = F.map_concat(result, fresh)
    return result
