"""Queries of the rule language: filters, matches, values, schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.plans.points import NODES, TAGS_TEXT, WAYS, current_nodes, current_ways, tags_text
from terrane.plans.registry import Tables, query
from terrane.rules import cel
from terrane.rules.ast import FALSE, TRUE, And, FieldIs, GeometryIs, Not, Or, TagIn, TagPresent, match_all, match_first
from terrane.rules.schema import SchemaPlan, attrs_at_zoom


def source_features(t: Tables):
    """Current ways and features of the map as rows that rules can test."""
    from terrane.operators import osm

    ways = current_ways(t).filter("tags is not null")
    return ways.select(
        F.col("way_id").alias("id"), F.lit("osm").alias("source"), F.lit("").alias("source_layer"), "tags", F.lit("way").alias("geom_type"),
        osm.can_be_line(F.col("node_ids"), F.col("tags")).alias("can_be_line"), osm.can_be_polygon(F.col("node_ids"), F.col("tags")).alias("can_be_polygon"),
        (F.size("node_ids") * 1000.0).alias("area_m2"), (F.size("node_ids") * 10.0).alias("length_m"), (F.size("node_ids") / 1e6).alias("world_area"),
    )


FEATURES = f"{WAYS}, f AS (SELECT way_id AS id, tags, len(node_ids) AS n, len(node_ids) >= 2 AND NOT (node_ids[1] = node_ids[-1] AND coalesce(tags['area'] = 'yes', FALSE)) AS can_be_line, coalesce(len(node_ids) >= 4 AND node_ids[1] = node_ids[-1] AND NOT coalesce(tags['area'] = 'no', FALSE), FALSE) AS can_be_polygon FROM cur_way WHERE tags IS NOT NULL)"


def _tested(t: Tables, **rules):
    return source_features(t).select("id", *[r.simplified().test().alias(k) for k, r in rules.items()])


@query(
    "flt01_logic",
    f"WITH {FEATURES} SELECT id, coalesce(tags['highway'] IN ('residential', 'footway'), FALSE) AND coalesce(tags['name'] <> '', FALSE) AS both, coalesce(tags['highway'] = 'service', FALSE) OR coalesce(tags['building'] <> '', FALSE) AS either, NOT coalesce(tags['highway'] <> '', FALSE) AS neither, TRUE AS always, FALSE AS never FROM f",
)
def flt01(t: Tables):
    return _tested(
        t, both=And((TagIn("highway", ("residential", "footway")), TagPresent("name"))), either=Or((TagIn("highway", ("service",)), TagPresent("building"))),
        neither=Not(TagPresent("highway")), always=Or((TRUE, TagPresent("x"))), never=And((FALSE, TagPresent("x"))),
    )


@query("flt06_wildcards", f"WITH {FEATURES} SELECT id, coalesce(regexp_matches(tags['name'], '^.*a.*e$'), FALSE) AS a_then_e, coalesce(starts_with(tags['highway'], 're'), FALSE) AS opens, coalesce(tags['name'] = '100%', FALSE) AS literal, coalesce(tags['surface'] <> '', FALSE) AS anything FROM f")
def flt06(t: Tables):
    return _tested(t, a_then_e=TagIn("name", ("%a%e",)), opens=TagIn("highway", ("re%",)), literal=TagIn("name", ("100\\%",)), anything=TagIn("surface", ("%",)))


@query("flt07_missing", f"WITH {FEATURES} SELECT id, coalesce(tags['surface'], '') = '' AS missing, coalesce(tags['surface'], '') IN ('', 'asphalt') AS missing_or_asphalt FROM f")
def flt07(t: Tables):
    return _tested(t, missing=TagIn("surface", ("",)), missing_or_asphalt=TagIn("surface", ("", "asphalt")))


@query("flt10_source_and_shape", f"WITH {FEATURES} SELECT id, TRUE AS osm, FALSE AS other, can_be_line AS line, can_be_polygon AS polygon FROM f")
def flt10(t: Tables):
    return _tested(t, osm=FieldIs("source", ("osm",)), other=FieldIs("source", ("overture",)), line=GeometryIs("line"), polygon=GeometryIs("polygon"))


RULES = [
    ("road", And((TagPresent("highway"), GeometryIs("line")))),
    ("named", TagPresent("name")),
    ("building", And((TagPresent("building"), GeometryIs("polygon")))),
    ("path", TagIn("highway", ("footway", "path"))),
    ("road", TagIn("railway", ("rail", "tram"))),
]


@query(
    "flt11_all_matches",
    f"""WITH {FEATURES} SELECT id, 'road' AS rule, CASE WHEN coalesce(tags['highway'] <> '', FALSE) AND can_be_line THEN 'highway' ELSE 'railway' END AS keys FROM f WHERE (coalesce(tags['highway'] <> '', FALSE) AND can_be_line) OR coalesce(tags['railway'] IN ('rail', 'tram'), FALSE)
UNION ALL SELECT id, 'named', 'name' FROM f WHERE coalesce(tags['name'] <> '', FALSE) UNION ALL SELECT id, 'building', 'building' FROM f WHERE coalesce(tags['building'] <> '', FALSE) AND can_be_polygon UNION ALL SELECT id, 'path', 'highway' FROM f WHERE coalesce(tags['highway'] IN ('footway', 'path'), FALSE)""",
)
def flt11(t: Tables):
    return match_all(source_features(t), RULES).select("id", "rule", F.array_join("match_keys", ",").alias("keys"))


@query(
    "flt12_first_match",
    f"WITH {FEATURES} SELECT id, CASE WHEN coalesce(tags['highway'] <> '', FALSE) AND can_be_line THEN 'road' WHEN coalesce(tags['name'] <> '', FALSE) THEN 'named' WHEN coalesce(tags['building'] <> '', FALSE) AND can_be_polygon THEN 'building' WHEN coalesce(tags['highway'] IN ('footway', 'path'), FALSE) THEN 'path' WHEN coalesce(tags['railway'] IN ('rail', 'tram'), FALSE) THEN 'road' ELSE 'other' END AS kind FROM f",
)
def flt12(t: Tables):
    return source_features(t).select("id", match_first(RULES, "other").alias("kind"))


@query("flt13_typed", f"WITH {FEATURES} SELECT id, CASE WHEN tags['bridge'] IS NULL THEN FALSE ELSE tags['bridge'] NOT IN ('', '0', 'false', 'no') END AS bridge FROM f")
def flt13(t: Tables):
    return _tested(t, bridge=TagIn("bridge", ("true",), "boolean"))


@query("flt15_scripts", f"WITH {FEATURES} SELECT id, coalesce(tags['highway'], '') = 'residential' AND n >= 4 AS script FROM f")
def flt15(t: Tables):
    names = {"feature.tags": F.col("tags"), "feature.length": lambda unit: F.col("length_m")}
    script = cel.compile_script('feature.tags["highway"] == "residential" && feature.length("m") >= 40', names)
    return source_features(t).select("id", F.coalesce(script, F.lit(False)).alias("script"))


@query(
    "exp03_scripts",
    f"""WITH {FEATURES} SELECT id, CASE WHEN tags['highway'] = 'footway' THEN 'path' ELSE coalesce(tags['highway'], 'none') END AS kind, replace(coalesce(tags['name'], ''), 'a', '_') AS replaced, upper(coalesce(tags['surface'], 'x')) || '!' AS loud,
CAST(length(coalesce(tags['name'], '')) AS INTEGER) AS name_length, coalesce(tags['surface'] IN ('asphalt', 'paved'), FALSE) AS smooth, CAST(list_max(list_transform(string_split(coalesce(tags['name'], ''), ' '), lambda w: length(w))) AS INTEGER) AS longest, len(list_filter(string_split(coalesce(tags['name'], ''), ' '), lambda w: length(w) > 3)) > 0 AS any_long FROM f""",
)
def exp03(t: Tables):
    names = {"tags": F.col("tags")}
    c = lambda s: cel.compile_script(s, names)
    return source_features(t).select(
        "id", c('tags["highway"] == "footway" ? "path" : coalesce(tags["highway"], "none")').alias("kind"), c('coalesce(tags["name"], "").replace("a", "_")').alias("replaced"),
        c('coalesce(tags["surface"], "x").upperAscii() + "!"').alias("loud"), c('size(coalesce(tags["name"], ""))').alias("name_length"), c('tags["surface"] in ["asphalt", "paved"]').alias("smooth"),
        c('max(coalesce(tags["name"], "").split(" ").map(w, size(w)))').alias("longest"), c('coalesce(tags["name"], "").split(" ").exists(w, size(w) > 3)').alias("any_long"),
    )


SCHEMA = """
args:
  top: {default: 13}
tag_mappings:
  oneway: direction
layers:
- id: transportation
  features:
  - source: osm
    geometry: line
    min_zoom:
      default_value: ${ args.top }
      overrides:
        6: {highway: [motorway, trunk]}
        9: {highway: [primary, secondary]}
    include_when:
      __all__:
      - highway: __any__
      - __not__: {highway: [proposed]}
    attributes:
    - {key: class, type: match_value}
    - {key: name, min_zoom: 14}
    - {key: oneway}
    - key: surface
      value: {match: {paved: {surface: [asphalt, paved]}, unpaved: __otherwise__}}
      exclude_when: {highway: footway}
    - {key: long, value: '${ feature.length("km") }', include_when: '${ feature.length("m") > 100.0 }'}
- id: building
  features:
  - source: osm
    geometry: polygon
    min_zoom: 13
    include_when: {building: __any__}
    attributes:
    - {key: kind, tag_value: building}
    - {key: label, coalesce: [{tag_value: name}, building], else: none}
"""


@query(
    "exp01_schema_features",
    f"""WITH {FEATURES}, r AS (SELECT id, 'transportation' AS layer, CASE WHEN tags['highway'] IN ('motorway', 'trunk') THEN 6 WHEN tags['highway'] IN ('primary', 'secondary') THEN 9 ELSE 13 END AS min_zoom,
 array_to_string(list_filter(['class=' || nullif(tags['highway'], ''), CASE WHEN n * 10 > 100 THEN 'long' END, CASE WHEN nullif(tags['name'], '') IS NOT NULL THEN 'name=' || tags['name'] END, 'oneway=' || CASE WHEN tags['oneway'] IN ('1', 'yes', 'true') THEN '1' WHEN tags['oneway'] = '-1' THEN '-1' ELSE '0' END,
 CASE WHEN tags['highway'] <> 'footway' THEN 'surface=' || CASE WHEN tags['surface'] IN ('asphalt', 'paved') THEN 'paved' ELSE 'unpaved' END END], lambda x: x IS NOT NULL), ';') AS attrs FROM f WHERE can_be_line AND coalesce(tags['highway'] <> '', FALSE) AND tags['highway'] <> 'proposed'),
b AS (SELECT id, 'building' AS layer, 13 AS min_zoom, 'kind=' || tags['building'] || ';label=' || coalesce(nullif(coalesce(tags['name'], 'building'), ''), 'none') AS attrs FROM f WHERE can_be_polygon AND coalesce(tags['building'] <> '', FALSE))
SELECT id, layer, CAST(min_zoom AS INTEGER) AS min_zoom, attrs FROM r UNION ALL SELECT id, layer, CAST(min_zoom AS INTEGER), attrs FROM b""",
)
def exp01(t: Tables):
    made = SchemaPlan.load(SCHEMA).features(source_features(t))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.when(e["key"] == "long", "long").otherwise(F.concat(e["key"], F.lit("="), e["value"])))), ";")
    return made.select("id", "layer", "min_zoom", shown.alias("attrs"))


@query("prj05_zoom_gated_attrs", f"WITH {FEATURES} SELECT id, CAST(z AS INTEGER) AS z, CAST(1 + CASE WHEN z >= 14 AND nullif(tags['name'], '') IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_attrs FROM f, (VALUES (13), (14)) v(z) WHERE coalesce(tags['highway'] <> '', FALSE) AND can_be_line")
def prj05(t: Tables):
    schema = SchemaPlan({"layers": [{"id": "r", "features": [{"geometry": "line", "include_when": {"highway": None}, "attributes": [{"key": "highway"}, {"key": "name", "min_zoom": 14}]}]}]})
    rows = schema.features(source_features(t)).withColumn("z", F.explode(F.array(F.lit(13), F.lit(14))))
    return rows.select("id", "z", F.size(attrs_at_zoom(F.col("attrs"), F.col("attr_zooms"), F.col("z"))).alias("n_attrs"))


KEPT_TAGS = TAGS_TEXT.format("map_from_entries(list_filter(map_entries(tags), lambda e: e.value IS NOT NULL AND e.value <> ''))")


@query("prj04_attrs", f"WITH {NODES} SELECT id, {KEPT_TAGS} AS attrs FROM cur_node WHERE cardinality(tags) > 0")
def prj04(t: Tables):
    from terrane.functions.tags import without_empty

    return current_nodes(t).filter(F.size("tags") > 0).select("id", tags_text(without_empty(F.col("tags"))).alias("attrs"))


@query("prj07_zoom_functions", "SELECT event_id, CAST(z AS INTEGER) AS z, CAST(CASE WHEN z <= 4 THEN 64 WHEN z <= 9 THEN 32 WHEN z <= 12 THEN 16 END AS DOUBLE) AS px FROM (SELECT event_id, event_id % 15 AS z FROM events) s")
def prj07(t: Tables):
    from terrane.functions.zooms import by_max_zoom

    return t("events").select("event_id", (F.col("event_id") % 15).cast("int").alias("z")).select("event_id", "z", by_max_zoom(F.col("z"), {4: 64.0, 9: 32.0, 12: 16.0}).alias("px"))


@query(
    "prj16_translations",
    f"WITH {NODES} SELECT id, tags['name'] AS name, coalesce(nullif(tags['name:en'], ''), nullif(tags['name'], '')) AS name_en FROM cur_node WHERE coalesce(tags['name'] <> '', FALSE)",
)
def prj16(t: Tables):
    from terrane.functions.zooms import translations

    named = current_nodes(t).filter(F.coalesce(F.col("tags")["name"] != "", F.lit(False)))
    own = F.map_filter("tags", lambda k, v: k.startswith("name:"))
    fallback = F.create_map(F.lit("name:en"), F.col("tags")["name"])
    return named.select("id", F.col("tags")["name"].alias("name"), F.try_element_at(translations([own, fallback], ["en"]), F.lit("name:en")).alias("name_en"))
