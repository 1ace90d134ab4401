"""Queries of layer statistics, comparisons, merges by attributes, set operations and the bundled programs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators import merge, stats, tiling
from terrane.plans.points import EVENTS, NODES, RELATIONS, WAYS, current_nodes, current_relations, current_ways, event_points
from terrane.plans.registry import Tables, query
from terrane.plans.tiles import ON_TILES, events_on_tiles

# one row per attribute value, however often it was delivered
ATTRS = "av AS (SELECT attr_id, any_value(tile_id) AS tile_id, any_value(layer) AS layer, any_value(feature_id) AS feature_id, any_value(field_name) AS field_name, any_value(string_value) AS s, any_value(double_value) AS d FROM layer_attrs WHERE attr_id IS NOT NULL GROUP BY attr_id)"
TILE_Z = "CAST(floor(log2(CAST(3 * tile_id + 1 AS DOUBLE)) / 2) AS INTEGER)"
STATS = f"{ATTRS}, st AS (SELECT tile_id, {TILE_Z} AS z, layer, count(DISTINCT feature_id) AS layer_features, count(*) AS layer_values, count(DISTINCT field_name) AS layer_attr_keys, count(DISTINCT coalesce(s, '#' || TRY_CAST(round(d * 1000) AS BIGINT))) AS layer_attr_values, CAST(sum(length(coalesce(s, '')) + 8) AS BIGINT) AS layer_bytes FROM av WHERE tile_id IS NOT NULL AND layer IS NOT NULL GROUP BY tile_id, layer)"
WEIGHTS = "wt AS (SELECT tile_id, tile_id % 50 AS loads FROM (SELECT DISTINCT tile_id FROM layer_attrs WHERE tile_id IS NOT NULL) q WHERE tile_id % 3 <> 0)"


def attrs(t: Tables):
    return t("layer_attrs").filter("attr_id is not null").select("attr_id", "tile_id", "layer", "feature_id", "field_name", F.col("string_value").alias("s"), F.col("double_value").alias("d")).dropDuplicates(["attr_id"])


def layer_stats(t: Tables):
    rows = attrs(t).filter("tile_id is not null and layer is not null").withColumn("value", F.coalesce("s", F.when(F.col("d").isNotNull(), F.concat(F.lit("#"), F.round(F.col("d") * 1000).try_cast("bigint").cast("string")))))
    counts = stats.tile_layer_stats(rows)
    sizes = rows.groupBy("tile_id", "layer").agg(F.sum(F.length(F.coalesce("s", F.lit(""))) + 8).alias("layer_bytes"))
    return counts.join(sizes, ["tile_id", "layer"]).withColumn("z", geo.tile_from_id(F.col("tile_id"))["z"])


def weights(t: Tables):
    return t("layer_attrs").filter("tile_id is not null and tile_id % 3 != 0").select("tile_id").distinct().withColumn("loads", F.col("tile_id") % 50)


@query("agg05_tile_layer_stats", f"WITH {STATS} SELECT tile_id, z, layer, layer_features, layer_values, layer_attr_keys, layer_attr_values, layer_bytes FROM st")
def agg05(t: Tables):
    return layer_stats(t).select("tile_id", "z", "layer", "layer_features", "layer_values", "layer_attr_keys", "layer_attr_values", "layer_bytes")


SUMMARY = f"""WITH {STATS}, {WEIGHTS}, c AS (SELECT z, layer, layer_bytes AS size, CAST(coalesce(loads, 0) AS DOUBLE) AS w FROM st LEFT JOIN wt USING (tile_id))
SELECT z, layer, CAST(grouping(z) * 2 + grouping(layer) AS BIGINT) AS level, max(size) AS max_size, count(*) AS n_tiles, round(avg(size), 6) AS mean_size, round(CASE WHEN sum(w) > 0 THEN sum(w * size) / sum(w) ELSE avg(size) END, 6) AS weighted_size FROM c GROUP BY GROUPING SETS ((z, layer), (z), (layer), ())"""


@query("agg09_summary_sets", SUMMARY)
def agg09(t: Tables):
    made = stats.summary(layer_stats(t), weights(t), "layer_bytes")
    return made.select("z", "layer", F.col("level").cast("bigint").alias("level"), "max_size", "n_tiles", F.round("mean_size", 6).alias("mean_size"), F.round("weighted_size", 6).alias("weighted_size"))


@query("agg06_summary_cells", f"SELECT z, layer, max_size, n_tiles, weighted_size FROM ({SUMMARY}) s WHERE level = 0")
def agg06(t: Tables):
    return agg09(t).filter("level = 0").select("z", "layer", "max_size", "n_tiles", "weighted_size")


@query("agg08_zoom_reweighted", f"WITH {STATS}, {WEIGHTS}, p AS (SELECT z, sum(loads * layer_bytes) / sum(loads) AS m FROM st JOIN wt USING (tile_id) GROUP BY z HAVING sum(loads) > 0), zw AS (SELECT {TILE_Z} AS z, sum(loads) AS w FROM wt GROUP BY 1) SELECT round(sum(m * w) / sum(w), 6) AS combined_size FROM p JOIN zw USING (z)")
def agg08(t: Tables):
    w = weights(t)
    cells = layer_stats(t).join(w, "tile_id")
    zooms = w.groupBy(geo.tile_from_id(F.col("tile_id"))["z"].alias("z")).agg(F.sum("loads").alias("zoom_weight"))
    return stats.combined_zooms(cells, zooms, "layer_bytes").select(F.round("combined_size", 6).alias("combined_size"))


@query("agg10_layer_schema", f"WITH {ATTRS}, k AS (SELECT layer, field_name, CASE WHEN d IS NOT NULL THEN 'Number' WHEN s IN ('true', 'false') THEN 'Boolean' ELSE 'String' END AS kind, {TILE_Z} AS z FROM av WHERE tile_id IS NOT NULL AND layer IS NOT NULL AND field_name IS NOT NULL AND (s IS NOT NULL OR d IS NOT NULL)) SELECT layer, field_name, CASE WHEN min(kind) = max(kind) THEN max(kind) ELSE 'String' END AS kind, min(z) AS minzoom, max(z) AS maxzoom, count(*) AS n_values FROM k GROUP BY layer, field_name")
def agg10(t: Tables):
    kind = F.when(F.col("d").isNotNull(), "Number").when(F.col("s").isin("true", "false"), "Boolean").otherwise("String")
    rows = attrs(t).filter("tile_id is not null and layer is not null and field_name is not null and (s is not null or d is not null)").withColumn("kind", kind).withColumn("z", geo.tile_from_id(F.col("tile_id"))["z"])
    return stats.layer_schema(rows, ["layer", "field_name"])


TILE_LOADS = f"WITH {EVENTS}, l AS (SELECT 8 AS z, CAST(floor(wx * 256) AS BIGINT) AS x, CAST(floor(wy * 256) AS BIGINT) AS y, count(*) AS loads FROM ev WHERE wy BETWEEN 0 AND 0.9999 GROUP BY ALL)"


def tile_loads(t: Tables):
    points = event_points(t).filter("wy between 0 and 0.9999")
    return points.groupBy(F.lit(8).alias("z"), geo.tile_column(F.col("wx"), F.lit(8)).alias("x"), geo.tile_column(F.col("wy"), F.lit(8)).alias("y")).agg(F.count("*").alias("loads"))


@query("agg04_top_tiles", f"{TILE_LOADS} SELECT CAST(z - 1 AS INTEGER) AS z, x >> 1 AS x, y >> 1 AS y, CAST(sum(loads) AS BIGINT) AS loads FROM l GROUP BY ALL ORDER BY loads DESC, z, x, y LIMIT 25")
def agg04(t: Tables):
    return stats.rolled_up_loads(tile_loads(t), 25)


@query("lim02_top_loads", f"{TILE_LOADS} SELECT x, y, loads FROM l ORDER BY loads DESC, x, y LIMIT 10")
def lim02(t: Tables):
    return tile_loads(t).select("x", "y", "loads").orderBy(F.desc("loads"), "x", "y").limit(10)


@query("lim03_biggest_layers", f"WITH {STATS} SELECT tile_id, layer, layer_bytes FROM st ORDER BY layer_bytes DESC, tile_id, layer LIMIT 12")
def lim03(t: Tables):
    return layer_stats(t).select("tile_id", "layer", "layer_bytes").orderBy(F.desc("layer_bytes"), "tile_id", "layer").limit(12)


@query("lim01_top_tiles_per_cell", f"WITH {STATS}, r AS (SELECT *, row_number() OVER (PARTITION BY z, layer ORDER BY layer_bytes DESC, tile_id) AS rank FROM st) SELECT z, layer, tile_id, layer_bytes, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def lim01(t: Tables):
    return stats.top_per_group(layer_stats(t), ["z", "layer"], [F.desc("layer_bytes"), F.col("tile_id")], 10).select("z", "layer", "tile_id", "layer_bytes", "rank")


@query("agg23_weighted_average", f"WITH {STATS}, {WEIGHTS} SELECT layer, round(sum(layer_bytes * loads) / sum(loads), 6) AS weighted FROM st JOIN wt USING (tile_id) GROUP BY layer HAVING sum(loads) > 0")
def agg23(t: Tables):
    joined = layer_stats(t).join(weights(t), "tile_id").groupBy("layer").agg(F.sum(F.col("layer_bytes") * F.col("loads")).alias("a"), F.sum("loads").alias("b"))
    return joined.filter("b > 0").select("layer", F.round(F.col("a") / F.col("b"), 6).alias("weighted"))


@query("agg24_pivot_by_zoom", f"WITH {STATS} SELECT layer, max(CASE WHEN z = 10 THEN layer_bytes END) AS z10, max(CASE WHEN z = 11 THEN layer_bytes END) AS z11, max(CASE WHEN z = 12 THEN layer_bytes END) AS z12 FROM st GROUP BY layer")
def agg24(t: Tables):
    wide = layer_stats(t).groupBy("layer").pivot("z", [10, 11, 12]).agg(F.max("layer_bytes"))
    return wide.select("layer", *[F.col(str(z)).alias(f"z{z}") for z in (10, 11, 12)])


@query("agg25_tile_rollup", f"WITH {STATS} SELECT tile_id, min(z) AS z, CAST(sum(layer_bytes) AS BIGINT) AS raw, count(*) AS n_layers FROM st GROUP BY tile_id")
def agg25(t: Tables):
    return layer_stats(t).groupBy("tile_id").agg(F.first("z").alias("z"), F.sum("layer_bytes").alias("raw"), F.count("*").alias("n_layers"))


@query("agg26_feature_check", f"WITH {STATS} SELECT layer, CAST(sum(layer_features) AS BIGINT) AS n_features, sum(layer_features) >= 100 AS enough FROM st WHERE z >= 10 GROUP BY layer")
def agg26(t: Tables):
    return layer_stats(t).filter("z >= 10").groupBy("layer").agg(F.sum("layer_features").alias("n_features")).withColumn("enough", F.col("n_features") >= 100)


@query("join13_tile_weights", f"WITH {STATS}, {WEIGHTS} SELECT tile_id, layer, coalesce(loads, 0) AS loads FROM st LEFT JOIN wt USING (tile_id)")
def join13(t: Tables):
    return layer_stats(t).join(weights(t), "tile_id", "left").select("tile_id", "layer", F.coalesce("loads", F.lit(0)).alias("loads"))


@query("join14_by_wikidata_number", "WITH f AS (SELECT event_id, 'Q' || (event_id % 3000) AS tag FROM events) SELECT event_id, p_name AS name FROM f LEFT JOIN part ON p_partkey = TRY_CAST(nullif(regexp_extract(tag, '^Q([0-9]+)$', 1), '') AS BIGINT)")
def join14(t: Tables):
    tagged = t("events").select("event_id", F.concat(F.lit("Q"), (F.col("event_id") % 3000).cast("string")).alias("tag"))
    number = F.nullif(F.regexp_extract("tag", r"^Q([0-9]+)$", 1), F.lit("")).try_cast("bigint")
    return tagged.withColumn("n", number).join(t("part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("name")), "n", "left").select("event_id", "name")


ARCHIVES = f"{STATS}, a AS (SELECT tile_id, layer, layer_values AS v FROM st WHERE tile_id % 7 <> 0), b AS (SELECT tile_id, layer, CASE WHEN tile_id % 5 = 0 THEN layer_values + 1 ELSE layer_values END AS v FROM st WHERE tile_id % 11 <> 0)"
DIFFS = f"WITH {ARCHIVES}, d AS (SELECT tile_id, layer, CASE WHEN a.v IS NULL THEN 'missing_left' WHEN b.v IS NULL THEN 'missing_right' WHEN a.v <> b.v THEN 'different' END AS diff FROM a FULL JOIN b USING (tile_id, layer))"


def _two_archives(t: Tables):
    st = layer_stats(t).select("tile_id", "layer", F.col("layer_values").alias("v"))
    return st.filter("tile_id % 7 != 0"), st.filter("tile_id % 11 != 0").withColumn("v", F.when(F.col("tile_id") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))


@query("join15_archive_diff", f"{DIFFS} SELECT tile_id, layer, diff FROM d WHERE diff IS NOT NULL")
def join15(t: Tables):
    return stats.compare(*_two_archives(t), ["tile_id", "layer"], "v")


@query("agg15_diff_counts", f"{DIFFS} SELECT layer, diff, count(*) AS n FROM d WHERE diff IS NOT NULL GROUP BY layer, diff")
def agg15(t: Tables):
    return stats.compare(*_two_archives(t), ["tile_id", "layer"], "v").groupBy("layer", "diff").agg(F.count("*").alias("n"))


@query("set04_missing_tiles", f"WITH {ARCHIVES} SELECT tile_id, layer FROM a EXCEPT SELECT tile_id, layer FROM b")
def set04(t: Tables):
    a, b = _two_archives(t)
    return a.select("tile_id", "layer").join(b.select("tile_id", "layer"), ["tile_id", "layer"], "left_anti")


@query(
    "set07_feature_sets",
    f"WITH {ATTRS}, s AS (SELECT tile_id, feature_id, string_agg(field_name || '=' || coalesce(s, ''), ';' ORDER BY field_name || '=' || coalesce(s, '')) AS f FROM (SELECT DISTINCT tile_id, feature_id, field_name, s FROM av WHERE tile_id IS NOT NULL AND feature_id IS NOT NULL AND field_name <> 'rank') q GROUP BY tile_id, feature_id), a AS (SELECT tile_id, list_sort(list_distinct(list(f))) AS fs FROM s GROUP BY tile_id), b AS (SELECT tile_id, list_sort(list_distinct(list(f))) AS fs FROM s WHERE feature_id % 101 <> 0 GROUP BY tile_id) SELECT a.tile_id FROM a LEFT JOIN b USING (tile_id) WHERE a.fs IS DISTINCT FROM b.fs",
)
def set07(t: Tables):
    """Tiles whose sets of features differ, ids and ranks left aside; features are reduced to digests before they meet."""
    rows = attrs(t).filter("tile_id is not null and feature_id is not null and field_name != 'rank'").select("tile_id", "feature_id", F.concat("field_name", F.lit("="), F.coalesce("s", F.lit(""))).alias("k")).distinct()
    features = rows.groupBy("tile_id", "feature_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ";"), 256).alias("f"))
    a = features.groupBy("tile_id").agg(F.array_sort(F.collect_set("f")).alias("content"))
    b = features.filter("feature_id % 101 != 0").groupBy("tile_id").agg(F.array_sort(F.collect_set("f")).alias("content"))
    return stats.compare(a, b, ["tile_id"], "content").select("tile_id")


@query("set01_union_of_sources", "SELECT source, count(*) AS n FROM (SELECT 'events' AS source FROM events UNION ALL SELECT 'customer' FROM customer UNION ALL SELECT 'part' FROM part) u GROUP BY source")
def set01(t: Tables):
    parts = [t(name).select(F.lit(name).alias("source")) for name in ("events", "customer", "part")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"))


@query("set02_int_ranges", "SELECT p_partkey, len(list_distinct(list_concat(a, b))) AS n_union, len(list_intersect(a, b)) AS n_both, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_minus FROM (SELECT p_partkey, generate_series(p_size, p_size + 10) AS a, generate_series(20, 20 + p_partkey % 9) AS b FROM part) s")
def set02(t: Tables):
    sets = t("part").select("p_partkey", F.sequence(F.col("p_size"), F.col("p_size") + 10).alias("a"), F.sequence(F.lit(20), F.lit(20) + (F.col("p_partkey") % 9).cast("int")).alias("b"))
    size = lambda c: F.size(c).cast("bigint")
    return sets.select("p_partkey", size(F.array_union("a", "b")).alias("n_union"), size(F.array_intersect("a", "b")).alias("n_both"), size(F.array_except("a", "b")).alias("n_minus"))


@query("set03_tile_union", f"WITH {ON_TILES} SELECT DISTINCT z, tx, ty FROM tiles WHERE event_type IN ('purchase', 'click')")
def set03(t: Tables):
    tiles = events_on_tiles(t)
    return tiles.filter("event_type = 'purchase'").select("z", "tx", "ty").union(tiles.filter("event_type = 'click'").select("z", "tx", "ty")).distinct()


@query("join17_tiles_in_shape", f"WITH {ON_TILES}, cover AS (SELECT DISTINCT z, tx, ty FROM tiles WHERE event_type = 'signup') SELECT event_id, z, tx, ty FROM tiles SEMI JOIN cover USING (z, tx, ty) WHERE event_type = 'click'")
def join17(t: Tables):
    tiles = events_on_tiles(t)
    cover = tiles.filter("event_type = 'signup'").select("z", "tx", "ty").distinct()
    return tiles.filter("event_type = 'click'").select("event_id", "z", "tx", "ty").join(cover, ["z", "tx", "ty"], "left_semi")


@query("join18_items_in_bounds", "WITH i AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 > 0 THEN CAST((s_suppkey * 7919) % 340 AS DOUBLE) - 170 END AS x0, CAST((s_suppkey * 104729) % 140 AS DOUBLE) - 75 AS y0, 1.0 + s_suppkey % 11 AS w FROM supplier) SELECT s_suppkey FROM i WHERE x0 IS NULL OR (x0 <= 60 AND x0 + w >= -30 AND y0 <= 50 AND y0 + w >= -20)")
def join18(t: Tables):
    from terrane.sources.catalog import meets_bounds

    k = F.col("s_suppkey")
    x0, y0, w = F.when(k % 10 > 0, ((k * 7919) % 340).cast("double") - 170), ((k * 104729) % 140).cast("double") - 75, 1.0 + k % 11
    items = t("supplier").select("s_suppkey", x0.alias("minx"), y0.alias("miny"), (x0 + w).alias("maxx"), (y0 + w).alias("maxy"))
    return items.filter(meets_bounds(-30, -20, 60, 50)).select("s_suppkey")


@query("agg03_by_equal_attrs", f"WITH {ON_TILES} SELECT z, tx, ty, event_type || '|' || CAST(value >= 50 AS VARCHAR) AS attrs, count(*) AS n, min(event_id) AS first_id, CASE WHEN count(*) > 1 THEN min(event_id) * 10 ELSE min(event_id) * 10 + 1 END AS merged_id FROM tiles WHERE z >= 4 GROUP BY z, tx, ty, attrs")
def agg03(t: Tables):
    shown = F.concat("event_type", F.lit("|"), (F.col("value") >= 50).cast("string"))
    grouped = merge.by_attributes(events_on_tiles(t).filter("z >= 4").withColumn("attrs", shown).withColumn("id", F.col("event_id") * 10 + 1), ["z", "tx", "ty"], "attrs", "id", F.col("event_id"))
    return grouped.select("z", "tx", "ty", "attrs", "n", F.floor(F.col("first_id") / 10).alias("first_id"), "merged_id")


@query("agg17_merged_points", f"WITH {ON_TILES} SELECT z, tx, ty, event_type, count(*) AS n, string_agg(CAST(round(px, 3) AS VARCHAR) || ' ' || CAST(round(py, 3) AS VARCHAR), ',' ORDER BY round(px, 3), round(py, 3)) AS points FROM tiles WHERE z = 6 GROUP BY ALL".replace("CAST(round(px, 3) AS VARCHAR) || ' ' || CAST(round(py, 3) AS VARCHAR)", "CAST(CAST(round(px * 100) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(py * 100) AS BIGINT) AS VARCHAR)").replace("ORDER BY round(px, 3), round(py, 3)", "ORDER BY CAST(round(px * 100) AS BIGINT), CAST(round(py * 100) AS BIGINT)"))
def agg17(t: Tables):
    q = events_on_tiles(t).filter("z = 6").select("z", "tx", "ty", "event_type", F.round(F.col("px") * 100).cast("bigint").alias("a"), F.round(F.col("py") * 100).cast("bigint").alias("b"))
    grouped = q.groupBy("z", "tx", "ty", "event_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("a", "b"))).alias("p"))
    return grouped.select("z", "tx", "ty", "event_type", "n", F.array_join(F.transform("p", lambda v: F.concat(v["a"].cast("string"), F.lit(" "), v["b"].cast("string"))), ",").alias("points"))


@query(
    "geo05_line_midpoints",
    f"""WITH {NODES}, {WAYS}, ref AS (SELECT way_id, len(node_ids) AS n, generate_subscripts(node_ids, 1) AS pos, unnest(node_ids) AS node_id FROM cur_way), p AS (SELECT way_id, n, pos, lon, lat, count(*) OVER (PARTITION BY way_id) AS found FROM ref JOIN cur_node ON cur_node.id = node_id WHERE lon IS NOT NULL AND lat IS NOT NULL),
s AS (SELECT way_id, pos, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM p WHERE found = n WINDOW w AS (PARTITION BY way_id ORDER BY pos)), d AS (SELECT *, sqrt(pow(lon2 - lon, 2) + pow(lat2 - lat, 2)) AS len FROM s WHERE lon2 IS NOT NULL), c AS (SELECT *, sum(len) OVER (PARTITION BY way_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto, sum(len) OVER (PARTITION BY way_id) AS total FROM d)
SELECT way_id, round(lon + (lon2 - lon) * (total / 2 - (upto - len)) / len, 4) AS lon, round(lat + (lat2 - lat) * (total / 2 - (upto - len)) / len, 4) AS lat FROM c WHERE total > 0 AND len > 0 AND upto >= total / 2 AND upto - len < total / 2""",
)
def geo05(t: Tables):
    from terrane.operators.osm import way_lines

    lines = way_lines(current_ways(t), current_nodes(t)).filter("size(line) >= 2")
    seg = F.zip_with(F.slice("line", F.lit(1), F.size("line") - 1), F.slice("line", F.lit(2), F.size("line") - 1), lambda a, b: F.struct(a["lon"].alias("x"), a["lat"].alias("y"), b["lon"].alias("x2"), b["lat"].alias("y2"), F.sqrt(F.pow(b["lon"] - a["lon"], 2) + F.pow(b["lat"] - a["lat"], 2)).alias("len")))
    return merge.point_along(lines.select("way_id", seg.alias("seg")), 0.5).select("way_id", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))


@query("src05_parquet_columns", "SELECT feature_id, count(*) AS n, min(source) AS source FROM geo_features GROUP BY feature_id")
def src05(t: Tables):
    return t("geo_features").groupBy("feature_id").agg(F.count("*").alias("n"), F.min("source").alias("source"))


@query("src12_json_lines", "SELECT row_id, json_extract_string(record, '$.id') AS id, CAST(json_array_length(json_keys(record)) AS BIGINT) AS n_keys FROM (SELECT row_id, any_value(record) AS record FROM file_rows GROUP BY row_id) s")
def src12(t: Tables):
    rows = t("file_rows").dropDuplicates(["row_id"])
    return rows.select("row_id", F.get_json_object("record", "$.id").alias("id"), F.size(F.json_object_keys("record")).cast("bigint").alias("n_keys"))


@query("qry01_points_with_label_grid", f"WITH {NODES}, p AS (SELECT id, (lon + 180) / 360 AS wx, lat FROM cur_node WHERE tags['amenity'] IS NOT NULL OR cardinality(tags) > 0) SELECT count(*) AS n_points FROM p WHERE lat BETWEEN -85 AND 85 AND wx BETWEEN 0 AND 1")
def qry01_count(t: Tables):
    nodes = current_nodes(t).filter(F.size("tags") > 0).filter(F.col("lat").between(-85, 85) & geo.world_x(F.col("lon")).between(0, 1))
    return nodes.agg(F.count("*").alias("n_points"))


@query("qry02_routes_on_ways", f"WITH {WAYS}, {RELATIONS} SELECT DISTINCT r.id AS relation_id, coalesce(r.tags['name'], 'route') AS name, way_id, coalesce(m.role, '') AS role FROM relation_members m JOIN cur_rel r ON r.id = m.relation_id JOIN cur_way ON way_id = m.member_ref WHERE m.member_type = 'way' AND r.tags['type'] = 'route'")
def qry02(t: Tables):
    routes = current_relations(t).filter(F.col("tags")["type"] == "route").select(F.col("id").alias("relation_id"), F.coalesce(F.col("tags")["name"], F.lit("route")).alias("name"))
    members = t("relation_members").filter("member_type = 'way'").select("relation_id", F.col("member_ref").alias("way_id"), F.coalesce("role", F.lit("")).alias("role")).distinct()
    return members.join(routes, "relation_id").join(current_ways(t).select("way_id"), "way_id").select("relation_id", "name", "way_id", "role")


@query("qry03_routes_ways_stops", f"WITH {WAYS}, {RELATIONS}, {NODES}, m AS (SELECT DISTINCT relation_id, member_type, member_ref FROM relation_members), r AS (SELECT id FROM cur_rel WHERE tags['type'] = 'route') SELECT 'stop' AS layer, member_ref AS id FROM m JOIN r ON r.id = relation_id JOIN cur_node n ON n.id = member_ref WHERE member_type = 'node' UNION SELECT 'way', member_ref FROM m JOIN r ON r.id = relation_id JOIN cur_way ON way_id = member_ref WHERE member_type = 'way' UNION SELECT 'route', id FROM r")
def qry03(t: Tables):
    routes = current_relations(t).filter(F.col("tags")["type"] == "route").select(F.col("id").alias("relation_id"))
    members = t("relation_members").join(routes, "relation_id", "left_semi").select("member_type", F.col("member_ref").alias("id")).distinct()
    stops = members.filter("member_type = 'node'").join(current_nodes(t).select("id"), "id").select(F.lit("stop").alias("layer"), "id")
    ways = members.filter("member_type = 'way'").join(current_ways(t).select(F.col("way_id").alias("id")), "id").select(F.lit("way").alias("layer"), "id")
    return stops.unionByName(ways).unionByName(routes.select(F.lit("route").alias("layer"), F.col("relation_id").alias("id"))).distinct()


@query("qry04_border_kinds", f"WITH {RELATIONS}, b AS (SELECT id, id % 12 AS level FROM cur_rel WHERE tags['type'] = 'boundary') SELECT id, CASE WHEN level <= 2 THEN 'country' WHEN level <= 4 THEN 'region' WHEN level <= 8 THEN 'local' ELSE 'other' END AS kind, CAST(CASE WHEN level <= 2 THEN 0 WHEN level <= 4 THEN 4 WHEN level <= 8 THEN 8 ELSE 12 END AS INTEGER) AS minzoom FROM b WHERE level >= 2")
def qry04(t: Tables):
    level = F.col("id") % 12
    rows = current_relations(t).filter(F.col("tags")["type"] == "boundary").filter(level >= 2)
    return rows.select("id", F.when(level <= 2, "country").when(level <= 4, "region").when(level <= 8, "local").otherwise("other").alias("kind"), F.when(level <= 2, 0).when(level <= 4, 4).when(level <= 8, 8).otherwise(12).alias("minzoom"))


@query("qry07_two_point_layers", f"WITH {NODES} SELECT id, 'transport' AS layer FROM cur_node WHERE coalesce(tags['highway'] <> '', FALSE) UNION ALL SELECT id, 'named' FROM cur_node WHERE coalesce(tags['name'] <> '', FALSE) OR coalesce(tags['ref'] <> '', FALSE)")
def qry07(t: Tables):
    from terrane.rules.ast import Or, TagPresent, match_all

    rules = [("transport", TagPresent("highway")), ("named", Or((TagPresent("name"), TagPresent("ref"))))]
    return match_all(current_nodes(t), rules).select("id", F.col("rule").alias("layer"))


@query("qry08_by_source_layer", "SELECT source_layer, geom_type, count(DISTINCT feature_id) AS n FROM geo_features WHERE source = 'overture' GROUP BY source_layer, geom_type")
def qry08(t: Tables):
    return t("geo_features").filter("source = 'overture'").groupBy("source_layer", "geom_type").agg(F.count_distinct("feature_id").alias("n"))


@query("qry12_tile_places", f"WITH {STATS}, x AS (SELECT DISTINCT tile_id, z, CAST(pow(2, z) AS BIGINT) AS n, tile_id - CAST(floor((pow(4, z) - 1) / 3) AS BIGINT) AS r FROM st) SELECT tile_id, z, round((r // n) * 360.0 / n - 180, 6) AS lon FROM x")
def qry12(t: Tables):
    at = geo.tile_from_id(F.col("tile_id"))
    tiles = layer_stats(t).select("tile_id").distinct().select("tile_id", at["z"].alias("z"), at["x"].alias("x"))
    return tiles.select("tile_id", "z", F.round(geo.world_lon(F.col("x") / F.pow(F.lit(2.0), F.col("z"))), 6).alias("lon"))


@query("win06_batches", "WITH c AS (SELECT tile_id, count(*) AS n FROM layer_attrs WHERE tile_id IS NOT NULL GROUP BY tile_id), r AS (SELECT *, tile_id % 16 AS part, sum(n) OVER (PARTITION BY tile_id % 16 ORDER BY tile_id ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT tile_id, CAST(run // 1000 AS BIGINT) AS batch FROM r")
def win06(t: Tables):
    sizes = t("layer_attrs").filter("tile_id is not null").groupBy("tile_id").agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy(F.col("tile_id") % 16).orderBy("tile_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sizes.select("tile_id", F.floor(run / 1000).alias("batch"))
