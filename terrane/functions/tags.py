"""Access to tag maps and nested values; a missing key or a value of another type is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def has(tags: Column, key: str, *values: str) -> Column:
    """Whether the key is there, or, with values, whether it has one of them. Never null."""
    if not values:
        return F.coalesce(F.map_contains_key(tags, key), F.lit(False))
    return F.coalesce(get(tags, key).isin(*values), F.lit(False))


def has_in_list(items: Column, *values: str) -> Column:
    return F.coalesce(F.arrays_overlap(items, F.array(*[F.lit(v) for v in values])), F.lit(False))


def get_or_default(tags: Column, key: str, default: Column) -> Column:
    return F.coalesce(get(tags, key), default)


def get_or_keep(mapping: Column, value: Column) -> Column:
    """The mapping of a value, or the value where it has none."""
    return F.coalesce(F.try_element_at(mapping, value), value)


def merged(left: Column, right: Column) -> Column:
    """Both maps; where a key is in both, the right one's value, whatever the session's policy for double keys."""
    keep = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(keep, right)


def without_empty(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: v.isNotNull() & (v != ""))


def path(value: Column, where: str, kind: str) -> Column:
    """The value at a JSON path of a VARIANT as a type, null where it is absent or of another type."""
    return F.try_variant_get(value, where, kind)


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970, for timestamps with or without a zone (those without mean UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def from_number_or_text(text: Column) -> Column:
    """A time from epoch milliseconds or ISO text."""
    return F.coalesce(F.timestamp_millis(F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))), F.try_to_timestamp(text))


def add_interval(ts: Column, months: int = 0, days: int = 0, millis: int = 0) -> Column:
    return ts + F.make_interval(F.lit(0), F.lit(months), F.lit(0), F.lit(days), F.lit(0), F.lit(0), F.lit(millis / 1000))
