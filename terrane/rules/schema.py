"""Map schemas in YAML: sources, layers, features and attributes, compiled to one plan per layer.

A schema row is a source feature with the columns id, source, source_layer, tags MAP<STRING,STRING>, geom_type, can_be_line and
can_be_polygon, and, if scripts measure, area_m2 and length_m. Every matching (feature, rule) gives one row of ``SchemaPlan.features``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo, parse
from terrane.rules import ast, cel

GEOMETRIES = {
    "any": "any", "point": "point", "line": "line", "split_line": "line", "polygon": "polygon", "polygon_centroid": "polygon", "line_centroid": "line", "line_midpoint": "line",
    "centroid": "any", "polygon_centroid_if_convex": "polygon", "polygon_point_on_surface": "polygon", "point_on_line": "line", "innermost_point": "any",
}


#: Modes that make a point of a line or a polygon.
POINT_MODES = ("polygon_centroid", "line_centroid", "line_midpoint", "centroid", "polygon_centroid_if_convex", "polygon_point_on_surface", "point_on_line", "innermost_point")


class SchemaError(ValueError):
    """The schema cannot be compiled."""


@dataclass
class Scope:
    """What scripts and rules can see: argument values, typed tags, and the columns of the place they stand in."""

    args: dict
    mappings: dict[str, tuple[str, str]]
    names: dict[str, object] = field(default_factory=dict)

    def bindings(self) -> dict:
        base: dict = {
            "feature.id": F.col("id"), "feature.source": F.col("source"), "feature.source_layer": F.col("source_layer"), "feature.tags": F.col("tags"), "feature.osm_type": F.col("geom_type"),
            "feature.area": lambda unit="m2": F.col("area_m2") * geo.AREA_UNITS[{"acres": "ac", "acre": "ac"}.get(unit, unit)],
            "feature.length": lambda unit="m": geo.in_unit(F.col("length_m"), unit), "args": {},
        }
        for name, value in self.args.items():
            base[f"args.{name}"] = base[name] = value
        base.pop("args")
        return base | self.names

    def script(self, text: str) -> Column:
        return cel.compile_script(text, self.bindings())

    def tag(self, key: str) -> Column:
        """A tag, re-read by its mapping if it has one."""
        kind, source = self.mappings.get(key, ("get", key))
        return parse.convert(F.try_element_at(F.col("tags"), F.lit(source)), kind)


def tag_mappings(raw: dict | None) -> dict[str, tuple[str, str]]:
    """key: type, or key: {type, input}."""
    return {k: (v, k) if isinstance(v, str) else (v.get("type", "get"), v.get("input", k)) for k, v in (raw or {}).items()}


_RESERVED = re.compile(r"^\\(_+(?:any|all|not)_+)$")


def _plain(value):
    """Text of a YAML scalar; ``\\__any__`` stands for the text ``__any__``."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return _RESERVED.sub(r"\1", str(value))


def rule(raw, scope: Scope, collect=ast.Or) -> ast.Rule:
    """A boolean expression: a map or list is an OR of its entries, ``__all__`` an AND, ``__not__`` a NOT."""
    if raw is None:
        return ast.FALSE
    if isinstance(raw, str) and raw.strip().lower() == "__any__":
        return ast.TRUE
    if (script := cel.script_of(raw)) is not None:
        return ast.Script(lambda: scope.script(script))
    if isinstance(raw, dict):
        return collect(tuple(_entry(str(k), v, scope) for k, v in raw.items()))
    if isinstance(raw, list):
        return collect(tuple(rule(item, scope) for item in raw))
    raise SchemaError(f"not a condition: {raw!r}")


def _entry(key: str, value, scope: Scope) -> ast.Rule:
    if key in ("__any__", "__all__") and isinstance(value, dict | list):
        return rule(value, scope, ast.Or if key == "__any__" else ast.And)
    if key == "__not__":
        return ast.Not(rule(value, scope))
    values = value if isinstance(value, list) else [] if value is None else [value]
    everything = value is None or any(isinstance(v, str) and v.strip() == "__any__" for v in values)
    wanted = tuple("" if v is None else _plain(v) for v in values)
    if (script := cel.script_of(key)) is not None:
        if script in ("feature.source", "feature.source_layer") and not everything:
            return ast.FieldIs(script.split(".")[1], wanted)
        made = lambda: scope.script(script).cast("string")
        return ast.Script(lambda: made().isNotNull() & (made() != "") if everything else made().isin(*wanted))
    key = _plain(key)
    if everything:
        return ast.TagPresent(key)
    kind, source = scope.mappings.get(key, (None, key))
    return ast.TagIn(source, wanted, kind)


def value(raw, scope: Scope) -> Column:
    """A value expression: constant, script, tag_value, arg_value, coalesce, match with else, default_value with overrides, or typed."""
    if raw is None:
        return F.lit(None)
    if (script := cel.script_of(raw)) is not None:
        return scope.script(script)
    if isinstance(raw, list):
        return _match(raw, scope)
    if isinstance(raw, dict):
        keys = set(raw)
        if "type" in keys:
            kind, rest = raw["type"], {k: v for k, v in raw.items() if k != "type"}
            if kind not in ("boolean", "string", "direction", "long", "integer", "double", "get"):
                raise SchemaError(f"unknown type {kind!r}")
            return parse.convert(value(rest, scope).cast("string"), kind)
        if keys == {"coalesce"}:
            return F.coalesce(*[value(v, scope).cast("string") for v in raw["coalesce"]])
        if keys == {"match"}:
            return _match(raw["match"], scope)
        if keys == {"default_value", "overrides"}:
            return F.coalesce(_match(raw["overrides"], scope), value(raw["default_value"], scope).cast("string"))
        if keys == {"tag_value"}:
            key = raw["tag_value"]
            return scope.tag(key) if cel.script_of(key) is None else F.try_element_at(F.col("tags"), value(key, scope))
        if keys == {"arg_value"}:
            return F.lit(scope.args.get(raw["arg_value"]))
        if keys == {"value"}:
            return value(raw["value"], scope)
        return _match(raw, scope)
    return F.lit(raw)


def _match(raw, scope: Scope) -> Column:
    """The value of the first case that holds, as text."""
    cases: list[tuple[object, ast.Rule]] = []
    fallback = None
    if isinstance(raw, list):
        for item in raw:
            if set(item) == {"if", "value"}:
                cases.append((item["value"], rule(item["if"], scope)))
            elif set(item) == {"else"}:
                fallback = item["else"]
                break
            else:
                raise SchemaError(f"not a case: {item!r}")
    else:
        for key, condition in raw.items():
            if isinstance(condition, str) and re.fullmatch(r"_*(default_value|otherwise|default)_*", condition):
                fallback = key
            else:
                cases.append((key, rule(condition, scope)))
    result = F.lit(None).cast("string") if fallback is None else value(fallback, scope).cast("string")
    for made, condition in reversed(cases):
        result = F.when(condition.simplified().test(), value(made, scope).cast("string")).otherwise(result)
    return result


@dataclass
class Attribute:
    key: str
    value: Column
    min_zoom: Column


def _attribute(raw: dict, scope: Scope) -> Attribute:
    key = raw["key"]
    if "value" in raw:
        made = value(raw["value"], scope)
    elif "tag_value" in raw or "arg_value" in raw or "coalesce" in raw:
        made = value({k: v for k, v in raw.items() if k in ("tag_value", "arg_value", "coalesce", "type")}, scope)
    elif raw.get("type") == "match_value":
        made = scope.bindings().get("match_value", F.lit(None))
    elif raw.get("type") == "match_key":
        made = scope.bindings().get("match_key", F.lit(None))
    else:
        made = parse.convert(F.try_element_at(F.col("tags"), F.lit(key)), raw["type"]) if raw.get("type") else scope.tag(key)
    text = F.nullif(made.cast("string"), F.lit(""))
    test = ast.And((rule(raw["include_when"], scope) if "include_when" in raw else ast.TRUE, ast.Not(rule(raw["exclude_when"], scope)) if "exclude_when" in raw else ast.TRUE)).simplified()
    text = F.when(test.test(), text)
    if raw.get("else") is not None:
        text = F.coalesce(text, value(raw["else"], scope).cast("string"))
    zoom = F.lit(0) if raw.get("min_zoom") is None else F.coalesce(value(raw["min_zoom"], scope).cast("string").try_cast("int"), F.lit(0))
    for v, z in (raw.get("min_zoom_by_value") or {}).items():
        zoom = F.when(text == _plain(v), F.lit(int(z))).otherwise(zoom)
    if "include_when" in raw and raw.get("min_tile_cover_size") is not None:  # honoured only together with include_when
        cover = geo.min_zoom_for_pixels(F.sqrt(F.col("world_area")), 256 * float(raw["min_tile_cover_size"]))
        zoom = F.greatest(zoom, F.coalesce(cover, F.lit(0)))
    return Attribute(key, text, zoom)


class SchemaPlan:
    """A compiled schema."""

    def __init__(self, raw: dict, args: dict | None = None):
        self.raw = raw
        declared = {k: v.get("default") if isinstance(v, dict) else v for k, v in (raw.get("args") or {}).items()}
        self.args = {k: v for k, v in (declared | (args or {})).items() if cel.script_of(v) is None}
        self.mappings = tag_mappings(raw.get("tag_mappings"))
        self.sources = raw.get("sources") or {}
        self.layers = [layer["id"] for layer in raw.get("layers") or []]

    @classmethod
    def load(cls, text: str, args: dict | None = None) -> SchemaPlan:
        import yaml

        return cls(yaml.safe_load(text), args)

    def _items(self) -> list[dict]:
        return [f for layer in self.raw["layers"] for f in layer["features"]]

    def used_sources(self) -> set[str]:
        """Sources that a rule names."""
        return {s for f in self._items() for s in _listed(f.get("source"))}

    def uses(self, source: str) -> bool:
        """Whether the source has to be read: a rule names it, or names none, which means any."""
        return any(not _listed(f.get("source")) or source in _listed(f["source"]) for f in self._items())

    def splits(self) -> bool:
        """Whether lines are cut where they meet."""
        return any(f.get("geometry") == "split_line" for f in self._items())

    def derives(self) -> bool:
        """Whether points are made of lines or polygons."""
        return any(f.get("geometry") in POINT_MODES for f in self._items())

    def measures(self) -> bool:
        """Whether a rule asks for areas or lengths."""
        text = str(self.raw)
        return any(word in text for word in ("feature.area", "feature.length", "min_tile_cover_size"))

    def features(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """(layer, id, source, geometry, min_zoom, max_zoom, min_size, min_size_at_max, sort_key, buffer, attrs, attr_zooms) of every match, and the columns ``keep``.

        All rules are tests over one scan of the features; a feature that matches several rules gives several rows.
        """
        hits = []
        for layer in self.raw["layers"]:
            for item in layer["features"]:
                scope = Scope(self.args, self.mappings)
                where = rule(item["include_when"], scope) if item.get("include_when") is not None else ast.TRUE
                parts: list[ast.Rule] = [where]
                if _listed(item.get("source")):
                    parts.append(ast.FieldIs("source", tuple(_listed(item["source"]))))
                if item.get("exclude_when") is not None:
                    parts.append(ast.Not(rule(item["exclude_when"], scope)))
                shape = item.get("geometry", "any")
                if shape not in GEOMETRIES:
                    raise SchemaError(f"unknown geometry {shape!r}")
                parts.append(ast.GeometryIs(GEOMETRIES[shape]))
                keys = where.simplified().keys()
                match_key = F.get(keys, F.lit(0))
                scope.names = {"match_key": match_key, "match_value": F.try_element_at(F.col("tags"), match_key)}
                attributes = [_attribute(a, scope) for a in item.get("attributes") or []]
                number = lambda name, kind, scope=scope, item=item, default=None: F.coalesce(value(item.get(name), scope).cast("string").try_cast(kind), F.lit(default).cast(kind))
                pairs = F.array(*[F.struct(F.lit(a.key).alias("key"), a.value.alias("value"), a.min_zoom.cast("int").alias("zoom")) for a in attributes]) if attributes else F.array().cast("array<struct<key:string,value:string,zoom:int>>")
                sort_key = number("sort_key", "int") if item.get("sort_key") is not None else -1 - number("sort_key_descending", "int") if item.get("sort_key_descending") is not None else F.lit(0)
                least = 0.0 if layer.get("tile_post_process") else None  # what is merged later must not be dropped before
                hits.append(
                    F.when(
                        ast.And(tuple(parts)).simplified().test(),
                        F.struct(
                            F.lit(layer["id"]).alias("layer"), F.lit(shape).alias("geometry"), number("min_zoom", "int", default=0).alias("min_zoom"), number("max_zoom", "int", default=14).alias("max_zoom"),
                            number("min_size", "double", default=least).alias("min_size"), number("min_size_at_max_zoom", "double", default=least).alias("min_size_at_max"), sort_key.alias("sort_key"), F.lit(layer.get("buffer")).cast("double").alias("buffer"),
                            F.filter(pairs, lambda p: p["value"].isNotNull()).alias("pairs"),
                        ),
                    )
                )
        exploded = df.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
        last = lambda kind: F.map_from_entries(F.transform("_hit.pairs", lambda p: F.struct(p["key"], p[kind])))
        columns = [F.col(f"_hit.{c}").alias(c) for c in ("layer", "geometry", "min_zoom", "max_zoom", "min_size", "min_size_at_max", "sort_key", "buffer")]
        return exploded.select("id", "source", *keep, *columns, last("value").alias("attrs"), last("zoom").alias("attr_zooms"))


def _listed(raw) -> list[str]:
    return [] if raw is None else [raw] if isinstance(raw, str) else list(raw)


def attrs_at_zoom(attrs: Column, attr_zooms: Column, z: Column) -> Column:
    """The attributes shown at a zoom: those whose own zoom is reached."""
    return F.map_filter(attrs, lambda k, v: z >= F.coalesce(F.try_element_at(attr_zooms, k), F.lit(0)))
