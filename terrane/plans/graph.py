"""Queries of the node / way / relation joins and of the spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import clusters, osm, spatial
from terrane.plans.points import NODES, RELATIONS, TAGS_TEXT, WAYS, current_nodes, current_relations, current_ways, event_points, tags_text
from terrane.plans.points import EVENTS
from terrane.plans.registry import Tables, query

REFS = "ref AS (SELECT way_id, len(node_ids) AS n, generate_subscripts(node_ids, 1) - 1 AS pos, unnest(node_ids) AS node_id FROM cur_way)"
PLACED = "placed AS (SELECT way_id, n, pos, node_id, lon, lat FROM ref JOIN cur_node ON cur_node.id = node_id WHERE lon IS NOT NULL AND lat IS NOT NULL), whole AS (SELECT *, count(*) OVER (PARTITION BY way_id) AS found FROM placed)"


@query("join01_way_nodes", f"WITH {NODES}, {WAYS}, {REFS}, {PLACED} SELECT way_id, CAST(pos AS INTEGER) AS pos, node_id, lon, lat FROM whole WHERE found = n")
def join01(t: Tables):
    return osm.way_nodes(current_ways(t), current_nodes(t))


@query("join01_way_lines", f"WITH {NODES}, {WAYS}, {REFS}, {PLACED} SELECT way_id, count(*) AS n_points, round(sum(sqrt(pow(dx, 2) + pow(dy, 2))), 6) AS degrees_long FROM (SELECT way_id, coalesce(lon - lag(lon) OVER w, 0) AS dx, coalesce(lat - lag(lat) OVER w, 0) AS dy FROM whole WHERE found = n WINDOW w AS (PARTITION BY way_id ORDER BY pos)) s GROUP BY way_id")
def join01_lines(t: Tables):
    lines = osm.way_lines(current_ways(t), current_nodes(t))
    steps = F.zip_with("line", F.slice("line", F.lit(2), F.size("line")), lambda a, b: F.coalesce(F.sqrt(F.pow(b["lon"] - a["lon"], 2) + F.pow(b["lat"] - a["lat"], 2)), F.lit(0.0)))
    return lines.select("way_id", F.size("line").cast("bigint").alias("n_points"), F.round(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x), 6).alias("degrees_long"))


MEMBERS = "mem AS (SELECT DISTINCT member_ref, relation_id, coalesce(role, '') AS role FROM relation_members WHERE member_type = 'way' AND relation_id IS NOT NULL AND member_ref IS NOT NULL)"


@query("join02_way_relations", f"WITH {WAYS}, {MEMBERS}, m AS (SELECT member_ref, string_agg(relation_id || ':' || role, ',' ORDER BY relation_id, role) AS relations FROM mem GROUP BY member_ref) SELECT way_id, coalesce(relations, '') AS relations FROM cur_way LEFT JOIN m ON member_ref = way_id")
def join02(t: Tables):
    infos = osm.memberships(t("relation_members"))
    shown = F.array_join(F.transform("relations", lambda r: F.concat(r["relation_id"].cast("string"), F.lit(":"), r["role"])), ",")
    return current_ways(t).join(infos, F.col("way_id") == F.col("member_ref"), "left").select("way_id", F.coalesce(shown, F.lit("")).alias("relations"))


@query(
    "join03_ancestors",
    r"""WITH RECURSIVE link AS (SELECT min(relation_id) AS parent, member_ref AS child FROM relation_members WHERE member_type = 'relation' AND role IN ('label', 'collection', 'subarea') AND relation_id IS NOT NULL AND member_ref IS NOT NULL GROUP BY member_ref),
node AS (SELECT parent AS id FROM link UNION SELECT child FROM link),
up AS (SELECT id AS start, id AS cur, 0 AS steps, [id] AS seen, FALSE AS closed FROM node UNION ALL SELECT start, parent, steps + 1, list_prepend(parent, seen), list_contains(seen, parent) FROM up JOIN link ON child = cur WHERE NOT closed),
bad AS (SELECT DISTINCT start FROM up WHERE closed)
SELECT start AS node_id, cur AS ancestor_id, CAST(steps AS INTEGER) AS distance FROM up WHERE steps > 0 AND start NOT IN (SELECT start FROM bad)""",
)
def join03(t: Tables):
    links = t("relation_members").filter("member_type = 'relation' and role in ('label', 'collection', 'subarea')").select(F.col("relation_id").alias("parent"), F.col("member_ref").alias("child"))
    from terrane.operators.hierarchy import descendants, hierarchies

    return descendants(hierarchies(links).filter("standing = 'tree'")).select(F.col("descendant_id").alias("node_id"), "ancestor_id", "distance")


@query("join04_relations_by_kind", f"WITH {RELATIONS}, {MEMBERS}, m AS (SELECT member_ref, tags['type'] AS kind, relation_id FROM mem JOIN cur_rel ON cur_rel.id = relation_id) SELECT member_ref, string_agg(CAST(relation_id AS VARCHAR), ',' ORDER BY relation_id) AS routes FROM (SELECT DISTINCT member_ref, relation_id FROM m WHERE kind = 'route') s GROUP BY member_ref")
def join04(t: Tables):
    typed = t("relation_members").join(current_relations(t).select(F.col("id").alias("relation_id"), F.col("tags")["type"].alias("kind")), "relation_id").filter("member_type = 'way' and member_ref is not null")
    every = typed.groupBy("member_ref").agg(F.array_sort(F.collect_set(F.struct("kind", "relation_id"))).alias("infos"))
    routes = F.transform(F.filter("infos", lambda i: i["kind"] == "route"), lambda i: i["relation_id"].cast("string"))
    return every.select("member_ref", F.array_join(routes, ",").alias("routes")).filter("routes != ''")


@query("join05_multipolygon_ways", f"WITH {WAYS}, {RELATIONS}, area AS (SELECT id FROM cur_rel WHERE tags['type'] IN ('multipolygon', 'boundary', 'land_area')) SELECT DISTINCT relation_id, way_id, member_pos, coalesce(role, '') AS role, len(node_ids) AS n_nodes FROM relation_members JOIN area ON area.id = relation_id JOIN cur_way ON way_id = member_ref WHERE member_type = 'way'")
def join05(t: Tables):
    found = osm.way_multipolygons(current_relations(t), t("relation_members"), current_ways(t))
    return found.select("relation_id", "way_id", "member_pos", "role", F.size("node_ids").cast("bigint").alias("n_nodes"))


@query(
    "join06_split_ways",
    f"""WITH {WAYS}, {REFS}, use AS (SELECT node_id FROM ref GROUP BY node_id HAVING count(*) > 1), cut AS (SELECT way_id, list(pos ORDER BY pos) AS cuts FROM ref JOIN use USING (node_id) WHERE pos > 0 AND pos < n - 1 GROUP BY way_id),
b AS (SELECT w.way_id, list_concat(list_concat([0], coalesce(cuts, [])), [len(node_ids) - 1]) AS b, node_ids FROM cur_way w LEFT JOIN cut USING (way_id) WHERE len(node_ids) >= 2), s AS (SELECT way_id, b, node_ids, unnest(generate_series(1, len(b) - 1)) AS k FROM b)
SELECT way_id, CAST(k - 1 AS INTEGER) AS segment, way_id + (k - 1) * (SELECT CAST(pow(10, length(CAST(max(way_id) AS VARCHAR))) AS BIGINT) FROM cur_way) AS segment_id, CAST(b[k] AS INTEGER) AS first_pos, CAST(b[k + 1] AS INTEGER) AS last_pos FROM s""",
)
def join06(t: Tables):
    return osm.split_at_shared_nodes(current_ways(t)).select("way_id", "segment", "segment_id", "first_pos", "last_pos")


@query("agg11_node_bounds", f"WITH {NODES} SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM cur_node")
def agg11(t: Tables):
    return osm.node_bounds(current_nodes(t))


@query("agg12_node_uses", f"WITH {WAYS}, {REFS} SELECT node_id, count(*) AS uses, max(way_id) AS last_way FROM ref GROUP BY node_id")
def agg12(t: Tables):
    refs = current_ways(t).select("way_id", F.explode("node_ids").alias("node_id"))
    return refs.groupBy("node_id").agg(F.count("*").alias("uses"), F.max("way_id").alias("last_way"))


@query("agg13_way_id_step", f"WITH {WAYS} SELECT max(way_id) AS max_way, CAST(pow(10, length(CAST(max(way_id) AS VARCHAR))) AS BIGINT) AS step FROM cur_way")
def agg13(t: Tables):
    return current_ways(t).agg(F.max("way_id").alias("max_way")).select("max_way", F.pow(F.lit(10.0), F.length(F.col("max_way").cast("string"))).cast("bigint").alias("step"))


@query("flt09_way_shapes", f"WITH {WAYS} SELECT way_id, len(node_ids) >= 2 AND NOT (node_ids[1] = node_ids[-1] AND coalesce(tags['area'] = 'yes', FALSE)) AS line, len(node_ids) >= 4 AND node_ids[1] = node_ids[-1] AND NOT coalesce(tags['area'] = 'no', FALSE) AS polygon FROM cur_way WHERE len(node_ids) > 0")
def flt09(t: Tables):
    ways = current_ways(t).filter("size(node_ids) > 0")
    return ways.select("way_id", osm.can_be_line(F.col("node_ids"), F.col("tags")).alias("line"), osm.can_be_polygon(F.col("node_ids"), F.col("tags")).alias("polygon"))


# rectangles of one to eleven degrees around made-up places of the suppliers
RECTS = "rect AS (SELECT s_suppkey AS area, CAST((s_suppkey * 7919) % 340 AS DOUBLE) - 170 AS x0, CAST((s_suppkey * 104729) % 140 AS DOUBLE) - 75 AS y0, 1.0 + s_suppkey % 11 AS w FROM supplier)"


def rectangles(t: Tables):
    k = F.col("s_suppkey")
    x0, y0, w = ((k * 7919) % 340).cast("double") - 170, ((k * 104729) % 140).cast("double") - 75, 1.0 + k % 11
    corner = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    ring = F.concat_ws(", ", corner(x0, y0), corner(x0 + w, y0), corner(x0 + w, y0 + w), corner(x0, y0 + w), corner(x0, y0))
    return t("supplier").select(k.alias("area"), F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt"))


@query("join07_point_in_polygon", f"WITH {EVENTS}, {RECTS} SELECT event_id, area FROM ev JOIN rect ON lon >= x0 AND lon < x0 + w AND lat >= y0 AND lat < y0 + w")
def join07(t: Tables):
    points = event_points(t).select(F.col("event_id").alias("key"), "lon", "lat")
    return spatial.containing(points, rectangles(t)).select(F.col("key").alias("event_id"), "area")


@query("join07_only_first", f"WITH {EVENTS}, {RECTS} SELECT event_id, min(area) AS area FROM ev JOIN rect ON lon >= x0 AND lon < x0 + w AND lat >= y0 AND lat < y0 + w GROUP BY event_id")
def join07_first(t: Tables):
    points = event_points(t).select(F.col("event_id").alias("key"), "lon", "lat")
    return spatial.first_containing(points, rectangles(t)).select(F.col("key").alias("event_id"), "area")


@query("join08_boxes_meet", f"WITH {RECTS} SELECT a.area AS area_a, b.area AS area_b FROM rect a JOIN rect b ON a.area < b.area AND a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.w AND b.y0 <= a.y0 + a.w")
def join08(t: Tables):
    return spatial.boxes_that_meet(rectangles(t)).select("area_a", "area_b")


@query("join09_containing_or_nearest", f"WITH {EVENTS}, {RECTS}, c AS (SELECT event_id, area, greatest(x0 - lon, 0, lon - x0 - w) AS dx, greatest(y0 - lat, 0, lat - y0 - w) AS dy FROM ev JOIN rect ON lon BETWEEN x0 - 3 AND x0 + w + 3 AND lat BETWEEN y0 - 3 AND y0 + w + 3), d AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance FROM c) SELECT event_id, arg_min(area, (round(distance, 9), area)) AS area, round(min(distance), 6) AS distance FROM d WHERE distance <= 3 GROUP BY event_id")
def join09(t: Tables):
    points = event_points(t).select(F.col("event_id").alias("key"), "lon", "lat")
    return spatial.containing_or_nearest(points, rectangles(t), 3.0).select(F.col("key").alias("event_id"), "area", F.round("distance", 6).alias("distance"))


@query("join10_points_within", f"WITH {EVENTS}, c AS (SELECT c_custkey, CAST((c_custkey * 7919) % 360000 AS DOUBLE) / 1000 - 180 AS x, CAST((c_custkey * 15485863) % 170000 AS DOUBLE) / 1000 - 85 AS y FROM customer) SELECT c_custkey, event_id FROM c JOIN ev ON abs(lon - x) <= 1 AND abs(lat - y) <= 1 AND pow(lon - x, 2) + pow(lat - y, 2) <= 1")
def join10(t: Tables):
    return spatial.points_within(_customers(t), event_points(t).select("event_id", "lon", "lat"), 1.0).select("c_custkey", "event_id")


@query("join11_nearest_point", f"WITH {EVENTS}, c AS (SELECT c_custkey, CAST((c_custkey * 7919) % 360000 AS DOUBLE) / 1000 - 180 AS x, CAST((c_custkey * 15485863) % 170000 AS DOUBLE) / 1000 - 85 AS y FROM customer) SELECT c_custkey, arg_min(event_id, (round(pow(lon - x, 2) + pow(lat - y, 2), 9), event_id)) AS event_id FROM c JOIN ev ON abs(lon - x) <= 1 AND abs(lat - y) <= 1 GROUP BY c_custkey")
def join11(t: Tables):
    return spatial.nearest_point(_customers(t), event_points(t).select("event_id", "lon", "lat"), 1.0, "c_custkey", "event_id")


def _customers(t: Tables):
    k = F.col("c_custkey")
    return t("customer").select("c_custkey", (((k * 7919) % 360000).cast("double") / 1000 - 180).alias("x"), (((k * 15485863) % 170000).cast("double") / 1000 - 85).alias("y"))


@query("join12_proximity_pairs", f"WITH {EVENTS}, p AS (SELECT event_id, lon, lat FROM ev WHERE event_type = 'purchase') SELECT a.event_id AS a, b.event_id AS b FROM p a JOIN p b ON a.event_id < b.event_id AND abs(a.lon - b.lon) <= 0.8 AND abs(a.lat - b.lat) <= 0.8 AND pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2) <= 0.64")
def join12(t: Tables):
    return _close_pairs(event_points(t).filter("event_type = 'purchase'"))


@query("join12_proximity_pairs_all_events")
def join12_all(t: Tables):
    return _close_pairs(event_points(t))


def _close_pairs(p):
    left, right = p.select(F.col("event_id").alias("a"), F.col("lon").alias("x"), F.col("lat").alias("y")), p.select(F.col("event_id").alias("b"), "lon", "lat")
    return spatial.points_within(left, right, 0.8).filter("a < b").select("a", "b")


@query("agg21_components", f"WITH RECURSIVE {EVENTS}, p AS (SELECT event_id, lon, lat FROM ev WHERE event_type = 'purchase'), e AS (SELECT a.event_id AS a, b.event_id AS b FROM p a JOIN p b ON a.event_id <> b.event_id AND abs(a.lon - b.lon) <= 0.8 AND abs(a.lat - b.lat) <= 0.8 AND pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2) <= 0.64), r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT node, b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node")
def agg21(t: Tables):
    return _close_components(event_points(t).filter("event_type = 'purchase'"))


@query("agg21_components_all_events")
def agg21_all(t: Tables):
    return _close_components(event_points(t))


def _close_components(p):
    return clusters.close_components(p.select(F.col("event_id").alias("key"), "lon", "lat"), 0.8)


@query("qry06_all_tagged", f"WITH {NODES} SELECT id, {TAGS_TEXT.format('tags')} AS tags, CAST(floor((lon + 180) / 360 * 16384) AS BIGINT) AS x FROM cur_node WHERE cardinality(tags) > 0 AND lon BETWEEN -180 AND 180")
def qry06(t: Tables):
    from terrane.functions import geo

    nodes = current_nodes(t).filter(F.size("tags") > 0).filter(F.col("lon").between(-180, 180))
    return nodes.select("id", tags_text(F.col("tags")).alias("tags"), geo.tile_column(geo.world_x(F.col("lon")), F.lit(14)).alias("x"))
