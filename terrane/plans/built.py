"""Queries of what SQL cannot express: geometry kernels, tiles as bytes, whole map builds. Tests compare them with brute force."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terrane.engine import Engine, Handler, Profile
from terrane.kernels import geometry as g
from terrane.operators import merge
from terrane.operators import osm
from terrane.operators import render as r
from terrane.plans.points import NODES, RELATIONS, WAYS, WORLD_Y, current_nodes, current_relations, current_ways
from terrane.plans.registry import Tables, query
from terrane.rules.ast import TRUE, And, GeometryIs, Or, TagIn, TagPresent


def _engine(t: Tables, profile: Profile, areas: bool = True) -> Engine:
    """Nodes, ways and the areas of relations; the latter can be left away where ways alone are asked for."""
    relations = (current_relations(t), t("relation_members")) if areas else ()
    return Engine(t.spark, profile).add_osm("osm", current_nodes(t), current_ways(t), *relations)


def roads_and_buildings(maxzoom: int = 8) -> Profile:
    options = r.RenderOptions(render_maxzoom=maxzoom)
    return Profile(
        "sample",
        [
            Handler(And((TagPresent("highway"), GeometryIs("line"))), {"layer": "road", "kind": "line", "minzoom": 4, "maxzoom": maxzoom, "attrs": F.create_map(F.lit("class"), F.col("tags")["highway"])}, layers=("road",)),
            Handler(And((TagPresent("building"), GeometryIs("polygon"))), {"layer": "building", "minzoom": 6, "maxzoom": maxzoom, "attrs": F.create_map(F.lit("kind"), F.col("tags")["building"])}, layers=("building",)),
        ],
        options,
    )


@query("til03_sliced_tiles")
def til03(t: Tables):
    made = _engine(t, roads_and_buildings()).rendered()
    return made.groupBy("layer", "z", "x", "y").agg(F.count("*").alias("n_features"), F.sum(F.size("ends")).alias("n_parts"))


@query("til04_filled_tiles")
def til04(t: Tables):
    zones = _zone_features(t, 6)
    return r.render(zones, r.RenderOptions(render_maxzoom=6)).filter("filled").select("id", "z", "x", "y")


@query("til05_covered_tiles")
def til05(t: Tables):
    return r.render(_zone_features(t, 5), r.RenderOptions(buffer=0.0, min_size=0.0, tolerance=0.0, tolerance_at_max=0.0, render_maxzoom=5)).select("id", "z", "x", "y").distinct()


def _zone_features(t: Tables, maxzoom: int):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from terrane.kernels.wkb import to_world
        from terrane.kernels.wkt import polygons

        for frame in frames:
            rows = [("zone", z, "polygon", to_world([ring.tolist() for ring in p]), 0, maxzoom, 0, {"name": str(n)}) for z, n, w in zip(frame["zone_id"], frame["zone_name"], frame["boundary_wkt"]) for p in polygons(w)]
            yield pd.DataFrame(rows, columns=["layer", "id", "kind", "shape", "minzoom", "maxzoom", "sort_key", "attrs"])

    return t("zones").select("zone_id", "zone_name", "boundary_wkt").mapInPandas(read, r.FEATURE)


@query("geo01_zone_measures")
def geo01(t: Tables):
    """Area, centroid, point on the surface and innermost point of each zone, in degrees."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from terrane.kernels.wkt import polygons

        for frame in frames:
            rows = []
            for zone, text in zip(frame["zone_id"], frame["boundary_wkt"]):
                parts = polygons(text)
                if not parts:
                    continue
                biggest = max(parts, key=g.area)
                c, s, i = g.centroid(biggest), g.point_on_surface(biggest), g.innermost_point(biggest, 0.05)
                rows.append((zone, sum(map(g.area, parts)), *map(float, c), *map(float, s), *map(float, i), g.is_convex(biggest[0])))
            yield pd.DataFrame(rows, columns=["zone_id", "area", "cx", "cy", "sx", "sy", "ix", "iy", "convex"])

    return t("zones").select("zone_id", "boundary_wkt").mapInPandas(measure, "zone_id bigint, area double, cx double, cy double, sx double, sy double, ix double, iy double, convex boolean")


@query("geo09_simplified_ways")
def geo09(t: Tables):
    """Points that stay of each way by each simplification, and lengths after smoothing."""
    lines = osm.way_lines(current_ways(t), current_nodes(t))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for way, line in zip(frame["way_id"], frame["line"]):
                p = np.array([(c["lon"], c["lat"]) for c in line], dtype=float)
                if len(p) < 2:
                    continue
                rows.append((way, len(p), len(g.douglas_peucker(p, 0.001)), len(g.visvalingam(p, 0.001)), len(g.visvalingam(p, 0.001, 0.7)), len(g.chaikin(p)), round(g.length(g.midpoint_smooth(p)), 9)))
            yield pd.DataFrame(rows, columns=["way_id", "n", "n_dp", "n_vw", "n_vw_weighted", "n_chaikin", "smooth_length"])

    return lines.mapInPandas(run, "way_id bigint, n bigint, n_dp bigint, n_vw bigint, n_vw_weighted bigint, n_chaikin bigint, smooth_length double")


@query("geo16_multipolygons")
def geo16(t: Tables):
    """Areas assembled from the ways of multipolygon relations: ring ends are joined whatever the roles say."""
    from terrane.streams import over_groups

    lines = osm.way_lines(current_ways(t), current_nodes(t))
    links = osm.way_multipolygons(current_relations(t), t("relation_members"), current_ways(t)).select("relation_id", "way_id", "member_pos")
    joined = links.join(lines, "way_id").select("relation_id", "member_pos", "way_id", F.transform("line", lambda p: F.array(p["lon"], p["lat"])).alias("line"))

    def run(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        once = group.drop_duplicates("way_id")
        polygons = g.assemble([np.array([list(p) for p in line]) for line in once["line"]])
        if polygons:
            yield pd.DataFrame({"relation_id": [group["relation_id"].iloc[0]], "n_ways": [len(once)], "n_polygons": [len(polygons)], "n_holes": [sum(len(p) - 1 for p in polygons)], "area": [round(sum(map(g.area, polygons)), 9)]})

    return over_groups(joined, ["relation_id"], run, "relation_id bigint, n_ways bigint, n_polygons bigint, n_holes bigint, area double")


@query("agg18_merged_roads")
def agg18(t: Tables):
    engine = _engine(t, roads_and_buildings(7))
    merged = r.merged(engine.rendered().filter("layer = 'road' and z = 7"), {"road": {"min_length": 0.0}})
    return merged.select("z", "x", "y", F.col("attrs")["class"].alias("attrs"), F.size("ends").alias("n_lines"), "id")


@query("agg20_merged_zones")
def agg20(t: Tables):
    rendered = r.render(_zone_features(t, 3), r.RenderOptions(render_maxzoom=3)).withColumn("attrs", F.create_map(F.lit("kind"), F.lit("zone")))
    return r.merged(rendered, {"zone": {"min_area": 1.0}}).groupBy("z", "x", "y").agg(F.count("*").alias("n_polygons"), F.sum(F.size("ends")).alias("n_rings"))


@query("snk13_encoded_tiles")
def snk13(t: Tables):
    tiles = _engine(t, roads_and_buildings(6)).tiles()
    return tiles.select("z", "x", "y", "n_features", F.sha2("data", 256).alias("digest"))


@query("snk16_decoded_tiles")
def snk16(t: Tables):
    return r.decode_tiles(_engine(t, roads_and_buildings(6)).tiles()).groupBy("z", "layer", "kind").agg(F.count("*").alias("n"), F.sum("n_parts").alias("n_parts"))


@query("qry01_points_with_label_limit")
def qry01(t: Tables):
    """Tagged nodes as labels on zooms 0 to 14: 32-pixel cells, four labels each up to zoom 12, by id."""
    options = r.RenderOptions(buffer=32.0, grid_px=32.0, grid_limit=4, grid_maxzoom=12, render_maxzoom=14)
    profile = Profile("labels", [Handler(GeometryIs("point"), {"layer": "label", "minzoom": 0, "maxzoom": 14})], options)
    return _engine(t, profile).rendered().select("id", "z", "x", "y", "cell")


@query("qry05_areas_of_two_pixels")
def qry05(t: Tables):
    options = r.RenderOptions(min_size=2.0, min_size_at_max=2.0, render_maxzoom=10)
    profile = Profile("areas", [Handler(And((TagPresent("building"), GeometryIs("polygon"))), {"layer": "area", "minzoom": 0, "maxzoom": 10})], options)
    return _engine(t, profile).rendered().select("id", "z", "x", "y")


NODE_TILES = f"""WITH {NODES}, placed AS (SELECT (lon + 180) / 360 AS wx, {WORLD_Y} AS wy FROM (SELECT lon, lat FROM cur_node WHERE lat IS NOT NULL AND lon IS NOT NULL AND (tags['name'] <> '' OR tags['ref'] <> '')) n),
zoomed AS (SELECT *, unnest(generate_series(3, 6)) AS z FROM placed),
spot AS (SELECT *, wx * pow(2, z) AS sx, wy * pow(2, z) AS sy, 4.0 / 256 + 0.1 / 4096 AS b FROM zoomed),
col AS (SELECT *, unnest(generate_series(CAST(floor(sx - b) AS BIGINT), CAST(floor(sx + b) AS BIGINT))) AS tx FROM spot),
tile AS (SELECT *, unnest(generate_series(greatest(CAST(floor(sy - b) AS BIGINT), 0), least(CAST(floor(sy + b) AS BIGINT), CAST(pow(2, z) AS BIGINT) - 1))) AS ty FROM col)
SELECT CAST(z AS INTEGER) AS z, CAST((tx + CAST(pow(2, z) AS BIGINT)) % CAST(pow(2, z) AS BIGINT) AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, count(*) AS n FROM tile GROUP BY ALL"""


@query("qry09_nodes_only", NODE_TILES)
def qry09(t: Tables):
    options = r.RenderOptions(render_maxzoom=6)
    profile = Profile("nodes", [Handler(Or((TagPresent("name"), TagPresent("ref"))), {"layer": "node", "minzoom": 3, "maxzoom": 6})], options)
    nodes = current_nodes(t).filter("size(tags) > 0 and lat is not null and lon is not null")
    points = nodes.select("id", F.lit("").alias("source_layer"), "tags", F.lit("point").alias("geom_type"), F.array(F.array(F.array("lon", "lat"))).alias("shape"))
    return Engine(t.spark, profile).add_features("nodes", points).rendered().groupBy("z", "x", "y").agg(F.count("*").alias("n"))


POWER = """
schema_name: Lines and houses
layers:
- id: line
  features:
  - {source: osm, geometry: line, min_zoom: 7, max_zoom: 8, include_when: {highway: [residential, service, footway]}, attributes: [{key: highway}, {key: name, min_zoom: 8}]}
  tile_post_process: {merge_line_strings: {min_length: 0.1}}
- id: house
  features:
  - {source: osm, geometry: polygon, min_zoom: 8, max_zoom: 8, include_when: {building: __any__}, attributes: [{key: building}]}
"""

# every construct that a full basemap schema uses, in one of our own: defaults, arguments, typed tags, overrides by value and by script, gated
# attributes, sizes, buffers, all geometry modes, merging
BASEMAP = """
schema_name: Basemap
schema_description: A small map of everything
attribution: none
args: {first_zoom: 4, top: 8}
tag_mappings: {population: integer, layer: {type: integer, input: layer}}
layers:
- id: street
  buffer: 8
  features:
  - source: osm
    geometry: line
    min_zoom: {default_value: 7, overrides: [{if: {highway: [motorway, trunk, primary]}, value: 5}, {if: {highway: [secondary, tertiary]}, value: 6}]}
    max_zoom: ${ args.top }
    include_when: {highway: __any__}
    exclude_when: {area: ['yes']}
    attributes:
    - {key: kind, type: match_value}
    - {key: name, min_zoom: 8}
    - {key: bridge, include_when: {bridge: 'yes'}, value: true}
    - {key: ref, tag_value: ref, min_zoom_by_value: {'1': 6}}
  tile_post_process: {merge_line_strings: {min_length: 0.5, tolerance: 0.2}}
- id: crossing
  features:
  - {source: osm, geometry: split_line, min_zoom: 8, max_zoom: 8, include_when: {__all__: [{highway: __any__}, {name: __any__}]}, attributes: [{key: name}]}
- id: building
  features:
  - source: osm
    geometry: polygon
    min_zoom: 7
    max_zoom: 8
    min_size: 0.5
    include_when: {building: __any__}
    attributes: [{key: kind, tag_value: building}, {key: big, value: '${ feature.area() > 1000000.0 }'}]
  tile_post_process: {merge_polygons: {min_area: 0.1}}
- id: label
  buffer: 16
  features:
  - {source: osm, geometry: polygon_centroid, min_zoom: 6, max_zoom: 8, include_when: {building: __any__}, attributes: [{key: kind, value: building}, {key: name, min_zoom: 7}]}
  - {source: osm, geometry: line_midpoint, min_zoom: 7, max_zoom: 8, include_when: {highway: __any__}, attributes: [{key: kind, value: street}, {key: length, value: '${ int(feature.length()) }', min_zoom: 8}]}
  - source: osm
    geometry: point
    min_zoom: ${ args.first_zoom }
    max_zoom: ${ args.top }
    include_when: {amenity: __any__, shop: __any__, name: __any__}
    sort_key: ${ feature.id % 1000 }
    attributes:
    - {key: kind, value: [{if: {amenity: __any__}, value: '${ feature.tags.amenity }'}, {if: {shop: __any__}, value: shop}, {else: place}]}
    - {key: name, min_zoom: 6, exclude_when: {name: ['unknown']}}
"""


def _schema_engine(t: Tables, text: str, maxzoom: int = 8, only: list[str] | None = None, **options) -> Engine:
    from terrane.rules.schema import SchemaPlan

    return _engine(t, Profile.of(SchemaPlan.load(text), options=r.RenderOptions(render_maxzoom=maxzoom, **options), only_layers=only))


@query("qry10_schema_build")
def qry10(t: Tables):
    """A small schema over all sources, down to encoded tiles."""
    return _schema_engine(t, POWER).tiles().select("z", "x", "y", "n_features")


@query("qry10_basemap_build")
def qry10_basemap(t: Tables):
    """A build of the basemap schema over all sources, down to encoded tiles."""
    return _schema_engine(t, BASEMAP).tiles().select("z", "x", "y", "n_features")


POINT_TAGS = "CASE WHEN tags['{0}'] <> '' THEN tags['{0}'] END"
SCHEMA_POINTS = f"""WITH {NODES}, tagged AS (SELECT id, lat, lon, {POINT_TAGS.format("amenity")} AS amenity, {POINT_TAGS.format("shop")} AS shop, {POINT_TAGS.format("name")} AS name FROM cur_node WHERE lat IS NOT NULL AND lon IS NOT NULL),
placed AS (SELECT id * 10 + 1 AS id, amenity, shop, name, (lon + 180) / 360 AS wx, {WORLD_Y} AS wy FROM tagged WHERE amenity IS NOT NULL OR shop IS NOT NULL OR name IS NOT NULL),
zoomed AS (SELECT *, unnest(generate_series(4, 8)) AS z FROM placed),
spot AS (SELECT *, wx * pow(2, z) AS sx, wy * pow(2, z) AS sy, 16.0 / 256 + 0.1 / 4096 AS b FROM zoomed),
col AS (SELECT *, unnest(generate_series(CAST(floor(sx - b) AS BIGINT), CAST(floor(sx + b) AS BIGINT))) AS tx FROM spot),
tile AS (SELECT *, unnest(generate_series(greatest(CAST(floor(sy - b) AS BIGINT), 0), least(CAST(floor(sy + b) AS BIGINT), CAST(pow(2, z) AS BIGINT) - 1))) AS ty FROM col)
SELECT id, CAST(z AS INTEGER) AS z, CAST((tx + CAST(pow(2, z) AS BIGINT)) % CAST(pow(2, z) AS BIGINT) AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, CAST(id % 1000 AS INTEGER) AS sort_key,
 CASE WHEN amenity IS NOT NULL THEN amenity WHEN shop IS NOT NULL THEN 'shop' ELSE 'place' END AS kind, CASE WHEN z >= 6 AND name <> 'unknown' THEN name END AS name FROM tile"""


@query("qry10_schema_points", SCHEMA_POINTS)
def qry10_points(t: Tables):
    """The point labels of the basemap, with the attributes that each zoom shows."""
    made = _schema_engine(t, BASEMAP, only=["label"]).rendered().filter("pmod(id, 10) = 1")
    return made.select("id", "z", "x", "y", "sort_key", F.col("attrs")["kind"].alias("kind"), F.col("attrs")["name"].alias("name"))


@query("udf01_python_handler")
def udf01(t: Tables):
    def handle(feature: dict):
        if feature["tags"].get("name"):
            yield {"layer": "name", "minzoom": 5, "maxzoom": 5, "attrs": {"length": str(len(feature["tags"]["name"]))}}

    return _engine(t, Profile("python", [Handler(TagIn("name", ("%",)), function=handle)], r.RenderOptions(render_maxzoom=5, min_size_at_max=0.0))).rendered().select("id", "z", "x", "y", F.col("attrs")["length"].alias("length"))


HOUSES = """
layers:
- id: house
  features:
  - {source: osm, geometry: polygon, min_zoom: 8, max_zoom: 8, include_when: {building: __any__}, attributes: [{key: kind, value: house}]}
  tile_post_process: {merge_polygons: {min_area: 0.01}}
"""


@query("agg28_schema_post_process")
def agg28(t: Tables):
    """Polygons of a schema merged per tile as its post-process asks."""
    from terrane.rules.schema import SchemaPlan

    profile = Profile.of(SchemaPlan.load(HOUSES), options=r.RenderOptions(render_maxzoom=8, min_size_at_max=0.0))
    return _engine(t, profile).rendered().groupBy("z", "x", "y").agg(F.count("*").alias("n_polygons"))


@query("qry11_two_small_schemas")
def qry11(t: Tables):
    from terrane.plans.rules import source_features
    from terrane.rules.schema import SchemaPlan

    features = source_features(t)
    made = [SchemaPlan.load(text).features(features).select("layer", "id", "min_zoom", F.size("attrs").alias("n_attrs")) for text in (POWER, HOUSES)]
    return made[0].unionByName(made[1])


@query("prj03_middle_halves")
def prj03(t: Tables):
    """The middle half of every way as a line feature, on tiles of zoom 8."""

    def handle(feature: dict):
        if feature["geom_type"] == "line":
            line = np.array([tuple(p) for p in feature["shape"][0]])
            yield {"layer": "part", "minzoom": 8, "maxzoom": 8, "shape": [g.part(line, 0.25, 0.75).tolist()], "attrs": {}}

    return _engine(t, Profile("parts", [Handler(GeometryIs("line"), function=handle)], r.RenderOptions(render_maxzoom=8)), areas=False).rendered().select("id", "z", "x", "y")


MODES = """
layers:
- id: polygons
  features:
  - {geometry: polygon_centroid, min_zoom: 6, max_zoom: 6, attributes: [{key: mode, value: polygon_centroid}]}
  - {geometry: polygon_centroid_if_convex, min_zoom: 6, max_zoom: 6, attributes: [{key: mode, value: polygon_centroid_if_convex}]}
  - {geometry: polygon_point_on_surface, min_zoom: 6, max_zoom: 6, attributes: [{key: mode, value: polygon_point_on_surface}]}
- id: lines
  features:
  - {geometry: line_centroid, min_zoom: 6, max_zoom: 6, attributes: [{key: mode, value: line_centroid}]}
  - {geometry: line_midpoint, min_zoom: 6, max_zoom: 6, attributes: [{key: mode, value: line_midpoint}]}
  - {geometry: point_on_line, min_zoom: 6, max_zoom: 6, attributes: [{key: mode, value: point_on_line}]}
  - {geometry: split_line, min_zoom: 6, max_zoom: 6, attributes: [{key: mode, value: split_line}]}
- id: all
  features:
  - {geometry: centroid, min_zoom: 6, max_zoom: 6, attributes: [{key: mode, value: centroid}]}
  - {geometry: innermost_point, min_zoom: 6, max_zoom: 6, attributes: [{key: mode, value: innermost_point}]}
  - {geometry: point, min_zoom: 6, max_zoom: 6, attributes: [{key: mode, value: point}]}
"""


@query("prj14_geometry_modes")
def prj14(t: Tables):
    """What the geometry modes of a schema, which names no source, make of every feature."""
    made = _schema_engine(t, MODES, 6, buffer=0.0, min_size_at_max=0.0).rendered()
    return made.select("layer", F.col("attrs")["mode"].alias("mode"), "kind", "id", "x", "y", F.size("ends").alias("n_parts"))


MEMBER_WAYS = f"""WITH {NODES}, {RELATIONS}, {WAYS}, known AS (SELECT id FROM cur_node WHERE lat IS NOT NULL AND lon IS NOT NULL),
whole AS (SELECT way_id FROM (SELECT way_id, unnest(node_ids) AS n FROM cur_way) u LEFT JOIN known ON known.id = u.n GROUP BY way_id HAVING count(*) = count(known.id)),
link AS (SELECT DISTINCT relation_id, member_ref AS way_id, coalesce(role, '') AS role FROM relation_members WHERE member_type = 'way')
SELECT way_id * 10 + 2 AS id, count(*) AS n_relations, min(relation_id) AS first_relation FROM whole JOIN link USING (way_id) JOIN cur_rel r ON r.id = relation_id WHERE r.tags['type'] <> '' GROUP BY way_id"""


@query("udf02_relations_on_ways", MEMBER_WAYS)
def udf02(t: Tables):
    """Ways as features that know the relations they are members of."""
    profile = Profile("members", [Handler(TRUE, {"attrs": F.create_map(F.lit("n"), F.size("relations").cast("string"), F.lit("first"), F.get("relations", F.lit(0))["id"].cast("string"))})], member_relations=TagPresent("type"))
    made = _engine(t, profile, areas=True).features().filter("pmod(id, 10) = 2 and attrs['first'] is not null")
    return made.select("id", F.col("attrs")["n"].cast("bigint").alias("n_relations"), F.col("attrs")["first"].cast("bigint").alias("first_relation"))


SPECS = [
    {"name": "road", "input": {"geometry": "line", "tags": {"highway": "service", "name": "x"}}, "output": {"layer": "line", "geometry": "line", "min_zoom": 7, "tags": {"highway": "service", "name": "x"}}},
    {"name": "house", "input": {"geometry": "polygon", "tags": {"building": "yes"}}, "output": {"layer": "house", "tags": {"building": "yes"}}},
    {"name": "other", "input": {"geometry": "point", "tags": {"building": "yes"}}, "output": []},
]


@query("udf15_schema_specs")
def udf15(t: Tables):
    from terrane.rules.schema import SchemaPlan
    from terrane.rules.specs import run

    outcomes = run(t.spark, SchemaPlan.load(POWER), SPECS)
    return t.spark.createDataFrame([(o.name, o.passed, "; ".join(o.problems)) for o in outcomes], "name string, passed boolean, problems string")


STREAMED = """SELECT CAST(ts AS DATE) AS day, CAST(floor((((event_id * 7919) % 360000) / 1000.0 - 180 + 180) / 360 * 4) AS BIGINT) AS x, count(*) AS n FROM events GROUP BY ALL"""


@query("ext01_streamed_daily_counts", STREAMED)
def ext01(t: Tables):
    """The event stream, read to its end: counts per day and tile column. An extension."""
    import uuid

    from terrane.session import checkpoint_dir
    from terrane.streaming.tiles import windowed_tile_counts

    events = t.spark.readStream.schema(t("events").schema).parquet(f"{t.folder}/events.parquet*")
    name = "s" + uuid.uuid4().hex
    counted = windowed_tile_counts(events, 2).writeStream.outputMode("complete").format("memory").queryName(name)
    counted.option("checkpointLocation", f"{checkpoint_dir(t.spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return t.spark.table(name).groupBy(F.to_date("start").alias("day"), "x").agg(F.sum("n").alias("n"))
