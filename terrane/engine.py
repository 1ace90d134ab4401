"""A map build as one plan: sources, a profile of handlers, rendering, per-layer post-processing, encoding, an archive.

A profile says what to make of which features. Handlers are preferably column rules (a compiled schema, or a rule with columns); a Python
callable per feature is possible and runs in Arrow batches. A feature whose callable fails is skipped, the others go on; a post-process
that fails leaves its features as they were. Every such failure is counted in ``Engine.failures``, and ``write`` returns the counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import render as r
from terrane.rules.ast import TRUE, Rule, chosen_layers, relevant
from terrane.rules.schema import POINT_MODES, SchemaPlan
from terrane.streams import kernel_partitions, over_groups, over_some_groups

_BASE = ("layer", "id", "kind", "shape", "minzoom", "maxzoom", "sort_key", "attrs")
_ALL = (*_BASE, *r.OPTIONAL)
_TYPES = {"minzoom": "int", "maxzoom": "int", "sort_key": "int", "id": "bigint"} | r.OPTIONAL


@dataclass
class Handler:
    """What becomes of features that a rule lets through.

    ``columns`` makes one output row per feature from columns named as in ``render.FEATURE`` and ``render.OPTIONAL``; ``function`` makes any
    number of rows, as dicts, from a feature given as a dict. Features of ways and nodes have ``relations`` if the profile keeps any.
    """

    rule: Rule = TRUE
    columns: dict[str, Column | str | int] | None = None
    function: Callable[[dict], Iterable[dict]] | None = None
    sources: tuple[str, ...] = ()
    layers: tuple[str, ...] = ()


@dataclass
class Profile:
    """Handlers, hooks and metadata of a map."""

    name: str = "map"
    handlers: list[Handler] = field(default_factory=list)
    options: r.RenderOptions = r.RenderOptions()
    merge: dict[str, dict] = field(default_factory=dict)
    post_process_layer: dict[str, Callable[[pd.DataFrame], pd.DataFrame | None]] = field(default_factory=dict)
    post_process_tile: Callable[[pd.DataFrame], pd.DataFrame | None] | None = None
    finish: Callable[[str, SparkSession], DataFrame | None] | None = None
    description: str = ""
    attribution: str = ""
    version: str = ""
    is_overlay: bool = False
    extra_metadata: dict = field(default_factory=dict)
    only_layers: list[str] | None = None
    exclude_layers: list[str] | None = None
    depends_on: dict[str, list[str]] = field(default_factory=dict)
    #: Relations (id, tags) that their members should know: the rule that chooses them.
    member_relations: Rule | None = None
    #: Ways that ``split_lines`` and schemas cut where they share nodes with each other.
    split_ways: Rule | None = None
    #: Functions of the nodes, ways or relations as a DataFrame, run before features are made; what one returns takes their place.
    preprocess: dict[str, Callable[[DataFrame], DataFrame | None]] = field(default_factory=dict)

    @classmethod
    def of(cls, schema: SchemaPlan, **options) -> Profile:
        """A profile whose features are those of a schema, with its post-process settings."""
        profile = cls(name=schema.raw.get("schema_name", "map"), description=schema.raw.get("schema_description", ""), attribution=schema.raw.get("attribution", ""), is_overlay=bool(schema.raw.get("is_overlay")), **options)
        profile.schema = schema
        if profile.split_ways is None and schema.splits():
            profile.split_ways = TRUE
        for layer in schema.raw["layers"]:
            post = layer.get("tile_post_process") or {}
            if lines := post.get("merge_line_strings"):
                profile.merge[layer["id"]] = {"min_length": lines.get("min_length", 0.5), "tolerance": lines.get("tolerance", -1.0)}
            elif polygons := post.get("merge_polygons"):
                profile.merge[layer["id"]] = {"min_area": polygons.get("min_area", 1.0)}
        return profile

    def cares_about(self, source: str, known: dict[str, str] | None = None) -> bool:
        """Whether any handler can use the source, or a part of it of which source layer or geometry are known; others are not read."""
        if (schema := getattr(self, "schema", None)) is not None and schema.uses(source):
            return True
        rules = [(str(k), h.rule) for k, h in enumerate(self.handlers) if not h.sources or source in h.sources]
        return bool(relevant(rules, {"source": source, **(known or {})}))

    @property
    def derives(self) -> bool:
        """Whether points may be made of lines or polygons while rendering."""
        return (schema := getattr(self, "schema", None)) is not None and schema.derives() or any("mode" in (h.columns or {}) or h.function is not None for h in self.handlers)

    def features(self, df: DataFrame, failed: Callable[[], None] | None = None) -> DataFrame:
        """All output rows of one source's features."""
        parts = []
        if (schema := getattr(self, "schema", None)) is not None:
            parts.append(_of_schema(schema, df))
        for handler in self.handlers:
            chosen = df.filter(handler.rule.simplified().test())
            if handler.sources:
                chosen = chosen.filter(F.col("source").isin(*handler.sources))
            if handler.function is not None:
                parts.append(_called(chosen, handler.function, failed))
            else:
                given = {"layer": "features", "kind": F.col("geom_type"), "minzoom": 0, "maxzoom": self.options.render_maxzoom, "sort_key": 0, "attrs": F.col("tags"), "id": F.col("id"), "shape": F.col("shape")} | (handler.columns or {})
                as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
                parts.append(chosen.select(*[(as_column(given.get(c)).cast(_TYPES[c]) if c in _TYPES else as_column(given[c])).alias(c) for c in _ALL]))
        if not parts:
            raise ValueError("the profile has no handler")
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        if self.only_layers or self.exclude_layers:
            known = sorted({x for h in self.handlers for x in h.layers} | set(getattr(self, "schema", None).layers if getattr(self, "schema", None) else []))
            union = union.filter(F.col("layer").isin(chosen_layers(known, self.only_layers, self.exclude_layers, self.depends_on)))
        return union


def split_lines(features: DataFrame) -> DataFrame:
    """The features of ways that have ``cuts`` as one feature for each piece; features of other sources stay whole."""
    if "cuts" not in features.columns:
        return features
    whole = F.col("cuts").isNull() | (F.size("cuts") < 3)
    pieces = features.withColumn("_piece", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("cuts") - 2))))
    first, last = F.get("cuts", F.col("_piece")), F.get("cuts", F.col("_piece") + 1)
    line = F.array(F.slice(F.get("shape", F.lit(0)), first + 1, last - first + 1))
    return pieces.withColumn("shape", F.when(whole, F.col("shape")).otherwise(line)).withColumn("id", F.when(whole, F.col("id")).otherwise(F.col("id") + F.col("_piece") * F.col("cut_step") * 10)).drop("_piece")


def _of_schema(schema: SchemaPlan, df: DataFrame) -> DataFrame:
    """The schema's features: its geometry modes, zooms of attributes, least sizes and buffers as rendering wants them."""
    keep = ["shape", "geom_type", *[c for c in ("cuts", "cut_step") if c in df.columns]]
    made = schema.features(df, tuple(keep))
    if schema.splits():
        made = made.withColumn("cuts", F.when(F.col("geometry") == "split_line", F.col("cuts"))) if "cuts" in df.columns else made
        made = split_lines(made)
    native = F.col("geom_type") == "point"
    mode = F.when(~native & F.col("geometry").isin(*POINT_MODES), F.col("geometry"))
    kind = F.when(native, "point").when(F.col("geometry").isin("line", "split_line", "line_centroid", "line_midpoint", "point_on_line"), "line").when(F.col("geometry").startswith("polygon"), "polygon").otherwise(F.col("geom_type"))
    return made.select(
        "layer", "id", kind.alias("kind"), "shape", F.col("min_zoom").alias("minzoom"), F.col("max_zoom").alias("maxzoom"), "sort_key", "attrs", "attr_zooms", "min_size", "min_size_at_max", "buffer", mode.alias("mode"),
        F.lit(None).cast(r.OPTIONAL["stretches"]).alias("stretches"), F.lit(None).cast("string").alias("made"),
    )


def _called(df: DataFrame, function: Callable[[dict], Iterable[dict]], failed: Callable[[], None] | None = None) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for record in frame.to_dict("records"):
                record["tags"] = dict(record["tags"]) if record["tags"] is not None else {}
                try:
                    made = list(function(record))
                except Exception:  # noqa: BLE001 - one bad feature must not end the build
                    if failed:
                        failed()
                    continue
                for m in made:
                    full = dict.fromkeys(r.OPTIONAL) | {"layer": "features", "id": record["id"], "kind": record["geom_type"], "shape": record["shape"], "minzoom": 0, "maxzoom": 14, "sort_key": 0, "attrs": record["tags"]} | m
                    rows.append(tuple(full[n] for n in names))
            yield pd.DataFrame(rows, columns=names)

    names = [n for n in _ALL if n != "made"]
    return df.mapInPandas(run, r.FEATURE + ", " + ", ".join(f"{c} {t}" for c, t in r.OPTIONAL.items() if c in names)).withColumn("made", F.lit("python"))


def post_processed(rendered: DataFrame, profile: Profile, failed: Callable[[], None] | None = None) -> DataFrame:
    """The tile hook, then the layer hooks, all of them in one stage; a hook that returns nothing or fails leaves its features alone."""

    def guarded(function, group: pd.DataFrame) -> pd.DataFrame:
        try:
            made = function(group.copy())
        except Exception:  # noqa: BLE001 - the features stay as they were
            if failed:
                failed()
            made = None
        return group if made is None else made

    if (tile_hook := profile.post_process_tile) is not None:
        rendered = over_groups(rendered, ["z", "x", "y"], lambda group: iter([guarded(tile_hook, group)]), r.RENDERED)
    if hooks := dict(profile.post_process_layer):
        rendered = over_some_groups(rendered, F.col("layer").isin(*hooks), ["z", "x", "y", "layer"], lambda group: iter([guarded(hooks[group["layer"].iloc[0]], group)]), r.RENDERED)
    return rendered


class Engine:
    """Sources and a profile; ``tiles`` is the plan of the encoded tiles, ``write`` runs it."""

    def __init__(self, spark: SparkSession, profile: Profile):
        self.spark, self.profile, self.sources = spark, profile, {}
        self._failed = {kind: spark.sparkContext.accumulator(0) for kind in ("handler", "shape", "hook", "merge", "area")}

    @property
    def failures(self) -> dict[str, int]:
        """How many features, shapes, hooks, merges and areas failed in what has run so far; a task that runs again counts again."""
        return {kind: counter.value for kind, counter in self._failed.items()}

    def _tell(self, kind: str) -> Callable[[], None]:
        counter = self._failed[kind]
        return lambda: counter.add(1)

    def add_features(self, name: str, df: DataFrame) -> Engine:
        """A source given as a DataFrame of features with degrees in ``shape``."""
        self.sources[name] = lambda: df
        return self

    def add_source(self, name: str, kind: str, path: str, **options) -> Engine:
        """A file source (shapefile, geopackage, natural_earth, geojson); it is only read if the profile cares."""
        from terrane.sources.files import features

        self.sources[name] = lambda: features(self.spark, kind, path, **options)
        return self

    def add_osm(self, name: str, nodes: DataFrame, ways: DataFrame, relations: DataFrame | None = None, members: DataFrame | None = None) -> Engine:
        """Nodes (id, lat, lon, tags) with tags, ways (way_id, node_ids, tags) all of whose nodes are known, and, if given, the areas of relations
        (id, tags) of type multipolygon, boundary or land_area, put together from their member ways (relation_id, member_type, member_ref, member_pos, role).
        """
        from terrane.functions.geo import feature_id
        from terrane.operators.osm import can_be_line, can_be_polygon, way_lines

        def make() -> DataFrame:
            nodes, ways, relations = (self._prepared(k, df) for k, df in given.items())
            points = nodes.filter("size(tags) > 0 and lat is not null and lon is not null").select(
                feature_id(F.col("id"), F.lit("node")).alias("id"), F.lit("").alias("source_layer"), "tags", F.lit("point").alias("geom_type"), F.lit(False).alias("can_be_line"), F.lit(False).alias("can_be_polygon"), F.array(F.array(F.array("lon", "lat"))).alias("shape"), F.col("id").alias("osm_id"),
            )
            lines = way_lines(ways, nodes, ["tags", "node_ids"], kernel_partitions(nodes))
            polygon = can_be_polygon(F.col("node_ids"), F.col("tags"))
            shaped = lines.select(
                feature_id(F.col("way_id"), F.lit("way")).alias("id"), F.lit("").alias("source_layer"), "tags", F.when(polygon, "polygon").otherwise("line").alias("geom_type"),
                can_be_line(F.col("node_ids"), F.col("tags")).alias("can_be_line"), polygon.alias("can_be_polygon"), F.array(F.transform("line", lambda p: F.array(p["lon"], p["lat"]))).alias("shape"), F.col("way_id").alias("osm_id"),
            )
            if self.profile.split_ways is not None:
                shaped = _with_cuts(shaped, ways, self.profile.split_ways)
            if self.profile.member_relations is not None and relations is not None and members is not None:
                kept = relations.filter(self.profile.member_relations.simplified().test())
                points, shaped = (_with_relations(df, kind, kept, members) for df, kind in ((points, "node"), (shaped, "way")))
            made = points.unionByName(shaped, allowMissingColumns=True)
            areas = None if relations is None or members is None else _areas(nodes, ways, relations, members, self._tell("area"))
            return (made if areas is None else made.unionByName(areas, allowMissingColumns=True)).drop("osm_id")

        given = {"nodes": nodes, "ways": ways, "relations": relations}

        self.sources[name] = make
        return self

    def add_schema_sources(self, folder: str = ".") -> Engine:
        """Every source that the profile's schema declares with a local file (``local_path``, or the last part of ``url`` in ``folder``)."""
        import os

        from terrane.sources import osm_pbf

        schema = getattr(self.profile, "schema", None)
        for name, spec in (schema.sources if schema else {}).items():
            path = spec.get("local_path") or os.path.join(folder, str(spec.get("url", "")).rstrip("/").split("/")[-1])
            if not os.path.isabs(path):
                path = os.path.join(folder, path)
            if spec.get("type") == "osm":
                nodes, ways, members = osm_pbf.tables(osm_pbf.read(self.spark, path))
                self.add_osm(name, nodes, ways.withColumnRenamed("id", "way_id"))
            else:
                self.add_source(name, spec.get("type", ""), path)
        return self

    def _prepared(self, kind: str, df: DataFrame | None) -> DataFrame | None:
        hook = self.profile.preprocess.get(kind)
        return df if hook is None or df is None else made if (made := hook(df)) is not None else df

    def features(self) -> DataFrame:
        parts = []
        for name, make in self.sources.items():
            if not self.profile.cares_about(name):
                continue
            df = make()
            kind = F.col("geom_type")
            if "can_be_line" not in df.columns:
                df = df.withColumn("can_be_line", kind == "line").withColumn("can_be_polygon", kind == "polygon")
            df = df.withColumn("source", F.lit(name))
            if (schema := getattr(self.profile, "schema", None)) is not None and schema.measures():
                df = _measured(df)
            df = df.withColumn("shape", _world(F.col("shape")))
            parts.append(self.profile.features(df, self._tell("handler")))
            if self.profile.finish is not None and (more := self.profile.finish(name, self.spark)) is not None:
                parts.append(r.with_optional(more).select(*_ALL))
        if not parts:
            return self.spark.createDataFrame([], r.FEATURE)
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        return union

    def rendered(self) -> DataFrame:
        made, merge = self._unmerged()
        return r.merged(made, merge, self._tell("merge")) if merge else made

    def _unmerged(self) -> tuple[DataFrame, dict[str, dict]]:
        """What is rendered before merging, and the layers to be merged."""
        derives = self.profile.derives
        made = r.label_limited(r.render(self.features(), self.profile.options, derives, self._tell("shape")), self.profile.options, derives)
        made = post_processed(made, self.profile, self._tell("hook"))
        p = self.profile
        merge = {k: v for k, v in p.merge.items() if k in chosen_layers(list(p.merge), p.only_layers, p.exclude_layers, p.depends_on)}
        return made, merge

    def tiles(self, skip_filled: bool = False) -> DataFrame:
        made, merge = self._unmerged()
        return r.encode_tiles(made, skip_filled=skip_filled, merge=merge, failed=self._tell("merge"))

    def metadata(self, bounds=(-180.0, -85.0, 180.0, 85.0)) -> dict:
        from terrane.sinks.archives import archive_metadata

        p = self.profile
        return archive_metadata(p.name, bounds, None, description=p.description, attribution=p.attribution, version=p.version, type="overlay" if p.is_overlay else "baselayer", **p.extra_metadata)

    def write(self, path: str) -> dict[str, int]:
        """Write the archive; returns what failed on the way, by kind."""
        from terrane.sinks.archives import write

        write(self.tiles(), path, self.metadata())
        return self.failures


def _with_cuts(features: DataFrame, ways: DataFrame, rule: Rule) -> DataFrame:
    """Adds ``cuts``, the positions at which a way is cut because the ways under the rule share its nodes, and ``cut_step`` for the pieces' ids."""
    from terrane.operators.osm import split_at_shared_nodes

    own = ways.filter(rule.simplified().test())
    pieces = split_at_shared_nodes(own)
    cuts = pieces.groupBy("way_id").agg(F.array_sort(F.collect_set("last_pos")).alias("after")).select(F.col("way_id").alias("osm_id"), F.concat(F.array(F.lit(0)), "after").alias("cuts"))
    step = own.agg(F.pow(F.lit(10.0), F.length(F.coalesce(F.max("way_id"), F.lit(1)).cast("string"))).cast("bigint").alias("step"))
    return features.join(cuts, "osm_id", "left").withColumn("cut_step", step.scalar())


def _with_relations(features: DataFrame, kind: str, relations: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``relations``: (id, role, tags) of every chosen relation that a feature is a member of, in the order of their ids."""
    links = members.filter(F.col("member_type") == kind).select("relation_id", F.col("member_ref").alias("osm_id"), F.coalesce("role", F.lit("")).alias("role")).distinct()
    told = links.join(relations.select(F.col("id").alias("relation_id"), F.col("tags").alias("relation_tags")), "relation_id")
    # a map cannot be ordered, so it is told by its entries and put together again
    one = told.groupBy("osm_id").agg(F.array_sort(F.collect_list(F.struct(F.col("relation_id").alias("id"), "role", F.map_entries("relation_tags").alias("entries")))).alias("found"))
    infos = one.select("osm_id", F.transform("found", lambda f: F.struct(f["id"].alias("id"), f["role"].alias("role"), F.map_from_entries(f["entries"]).alias("tags"))).alias("relations"))
    return features.join(infos, "osm_id", "left")


def _measured(df: DataFrame) -> DataFrame:
    """Adds length_m (of lines), area_m2 and world_area (of polygons) of shapes in degrees, by columns alone."""
    from terrane.functions import geo

    lon, lat = (lambda p: F.get(p, F.lit(0))), (lambda p: F.get(p, F.lit(1)))

    def along(step) -> Column:
        """For each part, the sum of step(from, to) over its segments."""
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("array<double>").alias("last"))
        return F.transform("shape", lambda part: F.aggregate(part, start, lambda a, p: F.struct((a["sum"] + F.coalesce(step(a["last"], p), F.lit(0.0))).alias("sum"), p.alias("last")), lambda a: a["sum"]))

    def less_holes(areas: Column) -> Column:
        return F.abs(F.get(areas, F.lit(0))) - F.aggregate(F.slice(areas, 2, F.greatest(F.size(areas) - 1, F.lit(0))), F.lit(0.0), lambda a, v: a + F.abs(v))

    sphere = along(lambda a, b: F.radians(lon(b) - lon(a)) * (2 + F.sin(F.radians(lat(a))) + F.sin(F.radians(lat(b)))) * (geo.EARTH_RADIUS_M**2 / 2))
    world = along(lambda a, b: (geo.world_x(lon(a)) * geo.world_y(lat(b)) - geo.world_x(lon(b)) * geo.world_y(lat(a))) / 2)
    metres = along(lambda a, b: geo.haversine_m(lon(a), lat(a), lon(b), lat(b)))
    polygon = F.col("can_be_polygon")
    total = F.aggregate(metres, F.lit(0.0), lambda a, v: a + v)
    return df.withColumns({"area_m2": F.when(polygon, less_holes(sphere)).otherwise(0.0), "world_area": F.when(polygon, less_holes(world)).otherwise(0.0), "length_m": F.when(F.col("geom_type") == "point", 0.0).otherwise(total)})


def _areas(nodes: DataFrame, ways: DataFrame, relations: DataFrame, members: DataFrame, failed: Callable[[], None] | None = None) -> DataFrame:
    """One polygon feature per closed area of each relation. A relation that cannot be put together gives none."""
    import numpy as np

    from terrane.functions.geo import feature_id
    from terrane.kernels.geometry import assemble
    from terrane.operators.osm import way_lines, way_multipolygons

    links = way_multipolygons(relations, members, ways).select("relation_id", "way_id").distinct()
    lines = links.join(way_lines(ways.join(links.select("way_id").distinct(), "way_id", "left_semi"), nodes), "way_id")
    flat = lines.select("relation_id", "way_id", F.transform("line", lambda p: F.array(p["lon"], p["lat"])).alias("line"))

    def run(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            polygons = assemble([np.array([tuple(p) for p in line]) for line in group.sort_values("way_id")["line"]])
        except (ValueError, IndexError):
            if failed:
                failed()
            return
        if polygons:
            yield pd.DataFrame({"relation_id": [group["relation_id"].iloc[0]] * len(polygons), "shape": [[r.tolist() for r in p] for p in polygons]})

    shapes = over_groups(flat, ["relation_id"], run, "relation_id bigint, shape array<array<array<double>>>", kernel_partitions(flat))
    joined = shapes.join(relations.select(F.col("id").alias("relation_id"), "tags"), "relation_id")
    return joined.select(feature_id(F.col("relation_id"), F.lit("relation")).alias("id"), F.lit("").alias("source_layer"), "tags", F.lit("polygon").alias("geom_type"), F.lit(False).alias("can_be_line"), F.lit(True).alias("can_be_polygon"), "shape", F.col("relation_id").alias("osm_id"))


def _world(shape: Column) -> Column:
    from terrane.functions.geo import world_x, world_y

    return F.transform(shape, lambda part: F.transform(part, lambda p: F.array(world_x(F.get(p, F.lit(0))), world_y(F.get(p, F.lit(1))))))
