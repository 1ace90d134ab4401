"""Golden examples of a schema: each gives an input feature and the features that must come out of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terrane.rules.schema import SchemaPlan, attrs_at_zoom

INPUT = "id bigint, source string, source_layer string, tags map<string,string>, geom_type string, can_be_line boolean, can_be_polygon boolean, area_m2 double, length_m double, world_area double"


@dataclass
class Outcome:
    name: str
    problems: list[str]

    @property
    def passed(self) -> bool:
        return not self.problems


def _listed(raw) -> list:
    return [] if raw is None else raw if isinstance(raw, list) else [raw]


def _text(v) -> str | None:
    return None if v is None else {True: "true", False: "false"}.get(v, str(v)) if isinstance(v, bool) else str(v)


def run(spark: SparkSession, schema: SchemaPlan, examples: list[dict]) -> list[Outcome]:
    """Run all examples in one plan. Expected features are paired with made ones best first: 2 for the layer, 1 for the geometry, 1 per tag."""
    rows = []
    for k, example in enumerate(examples):
        given = example["input"]
        kind = given.get("geometry", "point")
        rows.append((k, given.get("source") or "osm", given.get("source_layer") or "", {a: _text(b) for a, b in (given.get("tags") or {}).items()}, kind, kind == "line", kind == "polygon", 0.0, 0.0, 0.0))
    made = schema.features(spark.createDataFrame(rows, INPUT))
    full = made.select("id", "layer", "geometry", "min_zoom", "max_zoom", attrs_at_zoom(F.col("attrs"), F.col("attr_zooms"), F.lit(14)).alias("attrs")).collect()  # one row per example and rule
    by_example: dict[int, list[dict]] = {}
    for r in full:
        by_example.setdefault(r["id"], []).append({"layer": r["layer"], "geometry": r["geometry"], "min_zoom": r["min_zoom"], "max_zoom": r["max_zoom"], "tags": dict(r["attrs"])})
    return [Outcome(e.get("name", str(k)), _compared(_listed(e.get("output")), by_example.get(k, []))) for k, e in enumerate(examples)]


def _score(want: dict, got: dict) -> int:
    tags = want.get("tags") or {}
    return 2 * (want.get("layer") == got["layer"]) + (want.get("geometry") == got["geometry"]) + sum(got["tags"].get(k) == _text(v) for k, v in tags.items())


def _compared(wanted: list[dict], made: list[dict]) -> list[str]:
    if len(wanted) != len(made):
        return [f"expected {len(wanted)} features, got {len(made)}: {[m['layer'] for m in made]}"]
    problems, left = [], list(made)
    for want in wanted:
        got = max(left, key=lambda m: _score(want, m))
        left.remove(got)
        for name in ("layer", "geometry", "min_zoom", "max_zoom"):
            if name in want and want[name] != got[name]:
                problems.append(f"{name}: expected {want[name]!r}, got {got[name]!r}")
        for key, value in (want.get("tags") or {}).items():
            if got["tags"].get(key) != _text(value):
                problems.append(f"tag {key}: expected {_text(value)!r}, got {got['tags'].get(key)!r}")
        if not want.get("allow_extra_tags", True):
            problems += [f"unexpected tag {k}" for k in got["tags"] if k not in (want.get("tags") or {})]
    return problems
