"""Queries of single operators that the larger queries use without showing them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import geo, hashing, parse, tags, text
from terrane.kernels import geometry as g
from terrane.kernels import mvt
from terrane.operators import osm, stats, tiling
from terrane.plans.analytics import STATS, WEIGHTS, layer_stats, tile_loads, weights
from terrane.plans.analytics import TILE_LOADS
from terrane.plans.built import _engine, _zone_features, roads_and_buildings
from terrane.plans.points import EVENTS, NODES, WAYS, current_nodes, current_ways, event_points
from terrane.plans.registry import Tables, query
from terrane.plans.rules import FEATURES, _tested, source_features
from terrane.plans.scalars import LENIENT, SPELLED, spelled
from terrane.plans.tiles import CONTENT, events_on_tiles, ON_TILES, tile_contents
from terrane.rules import cel
from terrane.rules.ast import Not, Or, TagIn, TagPresent, Const
from terrane.rules.schema import SchemaPlan, Scope, rule, value


@query("flt02_or", f"WITH {FEATURES} SELECT id, coalesce(tags['highway'] = 'service', FALSE) OR coalesce(tags['building'] <> '', FALSE) AS hit FROM f")
def flt02(t: Tables):
    return _tested(t, hit=Or((TagIn("highway", ("service",)), TagPresent("building"))))


@query("flt03_not", f"WITH {FEATURES} SELECT id, coalesce(tags['highway'], '') <> 'service' AS hit FROM f")
def flt03(t: Tables):
    return _tested(t, hit=Not(TagIn("highway", ("service",))))


@query("flt04_constants", f"WITH {FEATURES} SELECT id, TRUE AS yes, FALSE AS no FROM f")
def flt04(t: Tables):
    return _tested(t, yes=Const(True), no=Const(False))


@query("flt05_tag_in", f"WITH {FEATURES} SELECT id, coalesce(tags['surface'] IN ('asphalt', 'gravel', 'paved'), FALSE) AS hit FROM f")
def flt05(t: Tables):
    return _tested(t, hit=TagIn("surface", ("asphalt", "gravel", "paved")))


@query("flt08_key_present", f"WITH {FEATURES} SELECT id, coalesce(tags['name'] <> '', FALSE) AS hit FROM f")
def flt08(t: Tables):
    return _tested(t, hit=TagPresent("name"))


@query("flt14_yaml_conditions", f"WITH {FEATURES} SELECT id, (coalesce(tags['highway'] IN ('residential', 'service'), FALSE) AND NOT coalesce(tags['name'] <> '', FALSE)) OR coalesce(tags['building'] = 'house', FALSE) AS hit FROM f")
def flt14(t: Tables):
    raw = {"__any__": [{"__all__": [{"highway": ["residential", "service"]}, {"__not__": {"name": "__any__"}}]}, {"building": "house"}]}
    return _tested(t, hit=rule(raw, Scope({}, {})))


@query("flt19_zoom_range", "SELECT event_id, CAST(unnest(generate_series(event_id % 4, 3 + event_id % 4)) AS INTEGER) AS z FROM events")
def flt19(t: Tables):
    low = (F.col("event_id") % 4).cast("int")
    return tiling.explode_zooms(t("events").select("event_id"), low, low + 3)


@query("flt23_contains_any", "SELECT l_orderkey, list_has_any(flags, ['R', 'A']) AS hit FROM (SELECT l_orderkey, list(l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey) s")
def flt23(t: Tables):
    flags = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return flags.select("l_orderkey", tags.has_in_list(F.col("flags"), "R", "A").alias("hit"))


@query("prj11_omit", f"WITH {FEATURES} SELECT id FROM f WHERE NOT coalesce(tags['access'] = 'private', FALSE)")
def prj11(t: Tables):
    return source_features(t).filter(Not(TagIn("access", ("private",))).test()).select("id")


@query("prj12_attribute_values", f"WITH {FEATURES} SELECT id, coalesce(CASE WHEN tags['surface'] <> '' AND coalesce(tags['highway'], '') <> 'footway' THEN tags['surface'] END, 'unknown') AS surface FROM f WHERE can_be_line")
def prj12(t: Tables):
    schema = SchemaPlan({"layers": [{"id": "l", "features": [{"geometry": "line", "attributes": [{"key": "surface", "exclude_when": {"highway": "footway"}, "else": "unknown"}]}]}]})
    return schema.features(source_features(t)).select("id", F.col("attrs")["surface"].alias("surface"))


@query("prj13_feature_parameters", f"WITH {FEATURES} SELECT id, CAST(CASE WHEN tags['highway'] = 'primary' THEN 5 ELSE 10 END AS INTEGER) AS min_zoom, CAST(12 AS INTEGER) AS max_zoom, CAST(-1 - len(node_ids_n) AS INTEGER) AS sort_key, 2.5 AS min_size FROM (SELECT id, tags, generate_series(1, n) AS node_ids_n, can_be_line FROM f) s WHERE can_be_line".replace("2.5 AS", "CAST(2.5 AS DOUBLE) AS"))
def prj13(t: Tables):
    schema = SchemaPlan({"layers": [{"id": "l", "features": [{"geometry": "line", "min_zoom": {"default_value": 10, "overrides": {5: {"highway": "primary"}}}, "max_zoom": 12, "min_size": 2.5, "sort_key_descending": '${ int(feature.length("m") / 10.0) }'}]}]})
    return schema.features(source_features(t)).select("id", "min_zoom", "max_zoom", "sort_key", "min_size")


@query("prj15_tag_mappings", f"WITH {FEATURES} SELECT id, CASE WHEN tags['oneway'] IN ('1', 'yes', 'true') THEN '1' WHEN tags['oneway'] = '-1' THEN '-1' ELSE '0' END AS way, CASE WHEN tags['bridge'] IS NULL THEN NULL WHEN tags['bridge'] IN ('', '0', 'false', 'no') THEN 'false' ELSE 'true' END AS bridge FROM f WHERE can_be_line")
def prj15(t: Tables):
    schema = SchemaPlan({"tag_mappings": {"way": {"type": "direction", "input": "oneway"}, "bridge": "boolean"}, "layers": [{"id": "l", "features": [{"geometry": "line", "attributes": [{"key": "way"}, {"key": "bridge"}]}]}]})
    a = F.col("attrs")
    return schema.features(source_features(t)).select("id", a["way"].alias("way"), a["bridge"].alias("bridge"))


@query("exp02_values", f"WITH {FEATURES} SELECT id, coalesce(tags['name'], 'none') AS name, 'osm' AS arg, CAST(TRY_CAST(tags['lanes'] AS BIGINT) AS BIGINT) AS lanes FROM f")
def exp02(t: Tables):
    scope = Scope({"area": "osm"}, {})
    return source_features(t).select(
        "id", value({"coalesce": [{"tag_value": "name"}, "none"]}, scope).alias("name"), value({"arg_value": "area"}, scope).alias("arg"), value({"tag_value": "lanes", "type": "long"}, scope).alias("lanes")
    )


@query("exp04_variables", f"WITH {FEATURES} SELECT id, id || '/osm/' || coalesce(tags['highway'], '') AS shown FROM f")
def exp04(t: Tables):
    script = 'string(feature.id) + "/" + feature.source + "/" + coalesce(feature.tags.highway, "")'
    return source_features(t).select("id", cel.compile_script(script, Scope({}, {}).bindings()).alias("shown"))


@query("str03_coalesce", "SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), nullif(p_type, ''), 'x') AS v FROM part")
def str03(t: Tables):
    return t("part").select("p_partkey", F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), text.null_if_empty(F.col("p_type")), F.lit("x")).alias("v"))


@query("str04_nullif", "SELECT p_partkey, nullif(p_size, 10) AS v FROM part")
def str04(t: Tables):
    return t("part").select("p_partkey", F.nullif("p_size", F.lit(10)).alias("v"))


@query("str05_null_if_empty", "SELECT attr_id, nullif(string_value, '') AS v FROM layer_attrs WHERE attr_id IS NOT NULL GROUP BY attr_id, string_value")
def str05(t: Tables):
    return t("layer_attrs").filter("attr_id is not null").dropDuplicates(["attr_id", "string_value"]).select("attr_id", text.null_if_empty(F.col("string_value")).alias("v"))


@query(
    "str07_without_latin",
    r"""SELECT s, nullif(array_to_string(list_filter(string_split(translate(trim(replace(replace(replace(replace(plain, '()', ''), '( )', ''), '(  )', ''), '(-)', ''), ' ./-'), chr(9), ' '), ' '), lambda w: w <> ''), ' '), '') AS v
FROM (SELECT s, array_to_string(list_filter(string_split(replace(s, ' (Café)', ''), ''), lambda c: NOT regexp_matches(c, '\p{Latin}')), '') AS plain FROM (SELECT DISTINCT string_value || ' (Café)' AS s FROM layer_attrs WHERE string_value <> '') q) x""",
)
def str07(t: Tables):
    made = t("layer_attrs").filter("string_value != ''").select(F.concat("string_value", F.lit(" (Café)")).alias("s")).distinct()
    return made.select("s", text.without_latin(F.col("s")).alias("v"))


@query("str09_transliterated")
def str09(t: Tables):
    return t("layer_attrs").filter("string_value != ''").select("string_value").distinct().select("string_value", hashing.transliterated("string_value").alias("plain"))


@query("str12_fnv_hashes")
def str12(t: Tables):
    return t("part").select("p_partkey", hashing.fnv1a64("p_name").alias("h64"), hashing.fnv1a32("p_name").alias("h32"))


@query("str13_varints")
def str13(t: Tables):
    return t("events").select("event_id", F.hex(hashing.varint_bytes("event_id")).alias("bytes"))


@query("src08_generated_ids")
def src08(t: Tables):
    return t("events").select("event_id", hashing.fnv1a64(F.concat(F.lit("events:0:"), F.col("event_id").cast("string"))).alias("id"))


@query("prs02_long_or_zero", f"SELECT event_id, coalesce(CAST(trunc({LENIENT}) AS BIGINT), 0) AS v FROM ({SPELLED}) q")
def prs02(t: Tables):
    return spelled(t).select("event_id", parse.long_or_zero(F.col("s")).alias("v"))


@query("prs04_rounded", "SELECT event_id, CAST(floor(CAST(CAST(value AS FLOAT) AS DOUBLE) + 0.5) AS INTEGER) AS v FROM (SELECT event_id, CAST(round(value * 10) AS BIGINT) / 10.0 AS value FROM events) s")
def prs04(t: Tables):
    tenths = F.round(F.col("value") * 10).cast("bigint")
    shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" m"))
    return t("events").select("event_id", parse.rounded_int(shown).alias("v"))


@query("prs06_direction", f"SELECT event_id, CAST(CASE WHEN s IN ('1', 'yes', 'true') THEN 1 WHEN s = '-1' THEN -1 ELSE 0 END AS INTEGER) AS v FROM ({SPELLED}) q")
def prs06(t: Tables):
    return spelled(t).select("event_id", parse.direction(F.col("s")).alias("v"))


@query("prs12_typed_casts", f"SELECT event_id, CAST(trunc({LENIENT}) AS BIGINT) AS as_long, CAST(CASE WHEN s IN ('1', 'yes', 'true') THEN 1 WHEN s = '-1' THEN -1 ELSE 0 END AS INTEGER) AS as_direction, s AS as_get FROM ({SPELLED}) q")
def prs12(t: Tables):
    return spelled(t).select("event_id", *[parse.convert(F.col("s"), k).alias(f"as_{k}") for k in ("long", "direction", "get")])


@query("arr01_contains_any", "SELECT vec_id, list_has_any([label, label + 1], [1, 3]) AS hit FROM embeddings")
def arr01(t: Tables):
    return t("embeddings").select("vec_id", F.arrays_overlap(F.array("label", F.col("label") + 1), F.array(F.lit(1), F.lit(3))).alias("hit"))


@query("arr03_index", "SELECT vec_id, embedding[3] AS third, embedding[100000] AS beyond FROM embeddings")
def arr03(t: Tables):
    return t("embeddings").select("vec_id", F.get("embedding", F.lit(2)).alias("third"), F.get("embedding", F.lit(99_999)).alias("beyond"))


@query("map02_get_or_default", f"WITH {WAYS} SELECT way_id, coalesce(tags['surface'], 'none') AS surface, CASE coalesce(tags['highway'], '') WHEN 'footway' THEN 'path' WHEN 'service' THEN 'minor' ELSE coalesce(tags['highway'], '') END AS kind FROM cur_way WHERE tags IS NOT NULL")
def map02(t: Tables):
    mapping = F.create_map(F.lit("footway"), F.lit("path"), F.lit("service"), F.lit("minor"))
    ways = current_ways(t).filter("tags is not null")
    return ways.select("way_id", tags.get_or_default(F.col("tags"), "surface", F.lit("none")).alias("surface"), tags.get_or_keep(mapping, F.coalesce(tags.get(F.col("tags"), "highway"), F.lit(""))).alias("kind"))


@query("jsn03_tags_as_json", f"WITH {NODES} SELECT id, CAST(to_json(map_from_entries(list_sort(map_entries(tags)))) AS VARCHAR) AS json FROM cur_node WHERE cardinality(tags) > 0")
def jsn03(t: Tables):
    nodes = current_nodes(t).filter(F.size("tags") > 0)
    return nodes.select("id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags")))).alias("json"))


@query("jsn04_or_else", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.none') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT) * 2) AS v FROM events")
def jsn04(t: Tables):
    v = F.parse_json("props")
    return t("events").select("event_id", F.coalesce(tags.path(v, "$.none", "bigint"), tags.path(v, "$.k", "bigint") * 2).alias("v"))


@query("dat02_time_parts", "SELECT event_id, epoch_us(ts) // 1000 AS millis, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day_number, CAST(epoch_us(ts) // 1000 % 86400000 AS BIGINT) AS milli_of_day, strftime(ts, '%Y-%m-%d') AS iso FROM events")
def dat02(t: Tables):
    ts, millis = F.col("ts"), tags.epoch_millis(F.col("ts"))
    return t("events").select("event_id", millis.alias("millis"), F.unix_date(F.to_date(ts)).alias("day_number"), F.pmod(millis, F.lit(86_400_000)).alias("milli_of_day"), F.date_format(ts, "yyyy-MM-dd").alias("iso"))


@query("dat03_intervals", "SELECT event_id, ts + INTERVAL 2 MONTH + INTERVAL 3 DAY + INTERVAL 4500 MILLISECOND AS later FROM events")
def dat03(t: Tables):
    return t("events").select("event_id", tags.add_interval(F.col("ts"), 2, 3, 4500).cast("timestamp_ntz").alias("later"))


@query("agg07_partial_then_final", f"WITH {STATS} SELECT layer, max(layer_bytes) AS top, CAST(sum(layer_bytes) AS BIGINT) AS total, count(*) AS n FROM st GROUP BY layer")
def agg07(t: Tables):
    """The two-step form of an aggregate that combines: what each part knows, then the parts."""
    parts = layer_stats(t).groupBy("layer", F.pmod(F.xxhash64("tile_id"), F.lit(16)).alias("part")).agg(F.max("layer_bytes").alias("top"), F.sum("layer_bytes").alias("total"), F.count("*").alias("n"))
    return parts.groupBy("layer").agg(F.max("top").alias("top"), F.sum("total").alias("total"), F.sum("n").alias("n"))


@query("agg27_part_counts", f"WITH {WAYS} SELECT way_id, len(node_ids) AS n_parts FROM cur_way")
def agg27(t: Tables):
    return current_ways(t).select("way_id", F.size("node_ids").cast("bigint").alias("n_parts"))


@query("win07_interval_pieces", "WITH r AS (SELECT l_orderkey, least(l_quantity, 50 - l_quantity) / 50 AS a, greatest(l_quantity, 50 - l_quantity) / 50 AS b FROM lineitem), p AS (SELECT DISTINCT l_orderkey, at_ FROM (SELECT l_orderkey, unnest([a, b, 0.0, 1.0]) AS at_ FROM r) x) SELECT l_orderkey, count(*) - 1 AS n_pieces FROM p GROUP BY l_orderkey")
def win07(t: Tables):
    q = F.col("l_quantity")
    ends = t("lineitem").select("l_orderkey", F.explode(F.array(F.least(q, 50 - q) / 50, F.greatest(q, 50 - q) / 50, F.lit(0.0), F.lit(1.0))).alias("at")).distinct()
    return ends.groupBy("l_orderkey").agg((F.count("*") - 1).alias("n_pieces"))


@query("srt02_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS INTEGER) AS place FROM events")
def srt02(t: Tables):
    return t("events").select("event_id", F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy(F.desc("value"), "event_id")).alias("place"))


@query("srt05_descending_keys", "SELECT event_id, CAST(-1 - (CAST(event_id % 1000 AS INTEGER) - 500) AS INTEGER) AS reversed FROM events")
def srt05(t: Tables):
    return t("events").select("event_id", tiling.descending((F.col("event_id") % 1000).cast("int") - 500).cast("int").alias("reversed"))


@query("srt08_two_orders", f"WITH {EVENTS}, c AS (SELECT DISTINCT CAST(floor(wx * 16) AS BIGINT) AS x, CAST(floor(wy * 16) AS BIGINT) AS y FROM ev WHERE wy BETWEEN 0 AND 0.9999) SELECT x, y, 85 + x * 16 + (15 - y) AS tms, 85 + {geo.hilbert_sql(4, 'x', 'y')} AS hilbert FROM c")
def srt08(t: Tables):
    from terrane.sinks.archives import hilbert_id

    x, y = geo.tile_column(F.col("wx"), F.lit(4)), geo.tile_column(F.col("wy"), F.lit(4))
    cells = event_points(t).filter("wy between 0 and 0.9999").select(x.alias("x"), y.alias("y")).distinct().withColumn("z", F.lit(4))
    return cells.select("x", "y", geo.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tms"), hilbert_id(F.col("z"), F.col("x"), F.col("y")).alias("hilbert"))


@query("set06_ids_to_fetch", "SELECT DISTINCT TRY_CAST(nullif(regexp_extract(tag, '^Q([0-9]+)$', 1), '') AS BIGINT) AS id FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'none' ELSE 'Q' || (event_id % 3000) END AS tag FROM events) s WHERE regexp_matches(tag, '^Q[0-9]+$')")
def set06(t: Tables):
    tag = F.when(F.col("event_id") % 9 == 0, "none").otherwise(F.concat(F.lit("Q"), (F.col("event_id") % 3000).cast("string")))
    return t("events").select(F.nullif(F.regexp_extract(tag, r"^Q([0-9]+)$", 1), F.lit("")).try_cast("bigint").alias("id")).filter("id is not null").distinct()


@query("snk02_archive_rows", f"WITH {EVENTS}, c AS (SELECT DISTINCT CAST(floor(wx * 64) AS BIGINT) AS x, CAST(floor(wy * 64) AS BIGINT) AS y FROM ev WHERE wy BETWEEN 0 AND 0.9999) SELECT 6 AS zoom_level, x AS tile_column, 63 - y AS tile_row FROM c")
def snk02(t: Tables):
    x, y = geo.tile_column(F.col("wx"), F.lit(6)), geo.tile_column(F.col("wy"), F.lit(6))
    return event_points(t).filter("wy between 0 and 0.9999").select(F.lit(6).alias("zoom_level"), x.alias("tile_column"), (63 - y).alias("tile_row")).distinct()


@query(
    "snk04_directory",
    f"WITH {CONTENT}, d AS (SELECT tile_id, min(tile_id) OVER (PARTITION BY content) AS first_tile FROM content), g AS (SELECT *, tile_id - row_number() OVER (PARTITION BY first_tile ORDER BY tile_id) AS island FROM d) SELECT first_tile, min(tile_id) AS entry, count(*) AS run_length FROM g GROUP BY first_tile, island",
)
def snk04(t: Tables):
    d = stats.deduplicated(tile_contents(t)).select("tile_id", "first_tile")
    return tiling.runs(d, "tile_id", ["first_tile"]).select("first_tile", F.col("first").alias("entry"), F.col("length").alias("run_length"))


@query("snk10_layer_stats_rows", f"WITH {STATS} SELECT z, tile_id, layer, layer_bytes, layer_features, layer_attr_keys, layer_attr_values FROM st")
def snk10(t: Tables):
    return layer_stats(t).select("z", "tile_id", "layer", "layer_bytes", "layer_features", "layer_attr_keys", "layer_attr_values")


@query("snk11_tile_weights", f"{TILE_LOADS} SELECT CAST(z AS INTEGER) AS z, x, y, loads FROM l")
def snk11(t: Tables):
    return tile_loads(t).select("z", "x", "y", "loads")


@query("geo18_combined_lines", f"WITH {WAYS} SELECT tags['highway'] AS kind, count(*) AS n_lines, CAST(sum(len(node_ids)) AS BIGINT) AS n_points FROM cur_way WHERE tags['highway'] IS NOT NULL GROUP BY kind")
def geo18(t: Tables):
    return current_ways(t).filter(F.col("tags")["highway"].isNotNull()).groupBy(F.col("tags")["highway"].alias("kind")).agg(F.count("*").alias("n_lines"), F.sum(F.size("node_ids")).alias("n_points"))






# ---- geometry kernels over all ways or zones; tests compare the kernels with exact cases


def _lines(t: Tables):
    return osm.way_lines(current_ways(t), current_nodes(t))


def _per_way(t: Tables, function, columns: str):
    names = ["way_id", *[c.split()[0] for c in columns.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for way, line in zip(frame["way_id"], frame["line"]):
                p = np.array([(c["lon"], c["lat"]) for c in line], dtype=float).reshape(-1, 2)
                if len(p) >= 2 and (made := function(p)) is not None:
                    rows.append((way, *made))
            yield pd.DataFrame(rows, columns=names)

    return _lines(t).mapInPandas(run, f"way_id bigint, {columns}")


def _is_ring(p) -> bool:
    return len(p) >= 4 and (p[0] == p[-1]).all() and abs(g.signed_area(p)) > 0


@query("geo02_centroids")
def geo02(t: Tables):
    return _per_way(t, lambda p: tuple(map(float, g.centroid([p]) if _is_ring(p) else g.line_centroid(p))), "lon double, lat double")


@query("geo03_points_on_surface")
def geo03(t: Tables):
    return _per_way(t, lambda p: tuple(map(float, g.point_on_surface([p]))) if _is_ring(p) else None, "lon double, lat double")


@query("geo04_innermost_points")
def geo04(t: Tables):
    return _per_way(t, lambda p: tuple(map(float, g.innermost_point([p]) if _is_ring(p) else g.along(p, 0.5))), "lon double, lat double")


@query("geo06_middle_thirds")
def geo06(t: Tables):
    return _per_way(t, lambda p: (len(q := g.part(p, 1 / 3, 2 / 3)), round(g.length(q), 9)) if g.length(p) else None, "n_points int, length double")


@query("geo07_convex_centroids")
def geo07(t: Tables):
    return _per_way(t, lambda p: tuple(map(float, c)) if _is_ring(p) and (c := g.centroid_if_convex([p])) is not None else None, "lon double, lat double")


@query("geo08_repaired_polygons")
def geo08(t: Tables):
    return _per_way(t, lambda p: (len(q := g.union([[p]])), round(sum(map(g.area, q)), 9)) if _is_ring(p) else None, "n_polygons int, area double")


@query("geo10_visvalingam")
def geo10(t: Tables):
    return _per_way(t, lambda p: (len(p), len(g.visvalingam(p, 0.01, 0.0, _is_ring(p))), len(g.visvalingam(p, 0.01, 0.7, _is_ring(p)))), "n int, n_plain int, n_weighted int")


@query("geo12_smoothed")
def geo12(t: Tables):
    return _per_way(t, lambda p: (len(g.midpoint_smooth(p, 2)), len(g.chaikin(p, 2)), len(g.pipeline(lambda q: g.chaikin(q), lambda q: g.douglas_peucker(q, 0.001))(p))), "n_midpoint int, n_chaikin int, n_pipeline int")


@query("geo14_snapped_polygons")
def geo14(t: Tables):
    return _per_way(t, lambda p: (len(q := g.snapped([(p - p[0]) * 1e4], 1 / 16)), round(sum(map(g.area, q)), 6)) if _is_ring(p) else None, "n_polygons int, area double")


@query("geo15_buffered_polygons")
def geo15(t: Tables):
    return _per_way(t, lambda p: (round(sum(map(g.area, g.buffered([[(p - p[0]) * 1e4]], 1.0))), 3),) if _is_ring(p) else None, "area double")


@query("geo21_filled_tiles_of_zones")
def geo21(t: Tables):
    from terrane.operators import render as r

    return r.render(_zone_features(t, 6), r.RenderOptions(render_maxzoom=6)).filter("filled").groupBy("z").agg(F.count("*").alias("n_fills"))


@query("prj02_label_points")
def prj02(t: Tables):
    return _per_way(t, lambda p: (*map(float, g.centroid([p]) if _is_ring(p) else g.along(p, 0.5)), *map(float, g.along(p, 0.25))), "lon double, lat double, quarter_lon double, quarter_lat double")


@query("prj09_point_counts")
def prj09(t: Tables):
    return _per_way(t, lambda p: (len(p), len(g.douglas_peucker(p, 0.01))), "n_points int, n_simplified int")


@query("agg19_overlapping_polygons")
def agg19(t: Tables):
    from terrane.operators import render as r

    rendered = r.render(_zone_features(t, 2), r.RenderOptions(render_maxzoom=2)).withColumn("attrs", F.create_map(F.lit("k"), F.lit("zone")))
    return r.merged(rendered, {"zone": {"kind": "polygon"}}).groupBy("z", "x", "y").agg(F.count("*").alias("n"))


@query("udf05_layer_hook")
def udf05(t: Tables):
    profile = roads_and_buildings(6)
    profile.post_process_layer = {"road": lambda group: group.assign(sort_key=range(len(group)))}
    return _engine(t, profile).rendered().groupBy("layer", "z").agg(F.count("*").alias("n"), F.max("sort_key").alias("last"))


@query("udf06_tile_hook")
def udf06(t: Tables):
    profile = roads_and_buildings(6)
    profile.post_process_tile = lambda group: group.sort_values(["id", "layer"]).assign(sort_key=range(len(group)))
    return _engine(t, profile).rendered().groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.max("sort_key").alias("last"))


@query("snk15_compressed_tiles")
def snk15(t: Tables):
    from terrane.operators import render as r

    def sizes(frames):
        for frame in frames:
            raw = [bytes(d) for d in frame["data"]]
            yield frame[["z", "x", "y"]].assign(gzip=[len(mvt.compressed(d, "gzip")) for d in raw], none=[len(d) for d in raw])

    return r.encode_tiles(_engine(t, roads_and_buildings()).rendered(), "none").select("z", "x", "y", "data").mapInPandas(sizes, "z int, x int, y int, gzip int, none int")
