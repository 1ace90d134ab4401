"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import geo, parse, tags, text
from terrane.operators.tiling import SortKey
from terrane.plans.points import EVENTS, event_points
from terrane.plans.registry import Tables, query

Z14 = "CAST(floor(wx * 16384) AS BIGINT) AS x, CAST(floor(wy * 16384) AS BIGINT) AS y"


@query("mth01_mercator", f"WITH {EVENTS} SELECT event_id, round(wx, 9) AS wx, round(wy, 9) AS wy, round(wx * 360 - 180, 6) AS lon, round(degrees(2 * atan(exp(pi() - 2 * pi() * wy))) - 90, 6) AS lat FROM ev")
def mth01(t: Tables):
    wx, wy = F.col("wx"), F.col("wy")
    return event_points(t).select("event_id", F.round(wx, 9).alias("wx"), F.round(wy, 9).alias("wy"), F.round(geo.world_lon(wx), 6).alias("lon"), F.round(geo.world_lat(wy), 6).alias("lat"))


@query(
    "mth02_pack_location",
    f"WITH {EVENTS} SELECT event_id, (CAST(floor(wx * 2147483647) AS BIGINT) << 32) | CAST(floor(wy * 2147483647) AS BIGINT) AS packed, round(floor(wx * 2147483647) / 2147483647, 9) AS x, round(floor(wy * 2147483647) / 2147483647, 9) AS y FROM ev",
)
def mth02(t: Tables):
    packed = geo.pack_location(F.col("lon"), F.col("lat"))
    return event_points(t).select("event_id", packed.alias("packed"), F.round(geo.unpack_x(packed), 9).alias("x"), F.round(geo.unpack_y(packed), 9).alias("y"))


@query("mth03_tile_ids", f"WITH {EVENTS}, tile AS (SELECT event_id, {Z14} FROM ev) SELECT event_id, x, y, 89478485 + x * 16384 + (16383 - y) AS tile_id, 14 AS back_z, x AS back_x, y AS back_y FROM tile")
def mth03(t: Tables):
    z, x, y = F.lit(14), geo.tile_column(F.col("wx"), F.lit(14)), geo.tile_column(F.col("wy"), F.lit(14))
    ids = event_points(t).select("event_id", x.alias("x"), y.alias("y"), geo.tile_id(z, x, y).alias("tile_id"))
    back = geo.tile_from_id(F.col("tile_id"))
    return ids.select("*", back["z"].alias("back_z"), back["x"].alias("back_x"), back["y"].alias("back_y"))


@query("mth04_hilbert", f"WITH {EVENTS}, tile AS (SELECT event_id, {Z14} FROM ev) SELECT event_id, {geo.hilbert_sql(14, 'x', 'y')} AS hilbert FROM tile")
def mth04(t: Tables):
    return event_points(t).select("event_id", geo.hilbert_index(14, geo.tile_column(F.col("wx"), F.lit(14)), geo.tile_column(F.col("wy"), F.lit(14))).alias("hilbert"))


@query("mth05_metres_per_pixel", "SELECT z, round(40075016.68557849 / pow(2, z + 8), 6) AS metres FROM (SELECT DISTINCT CAST(event_id % 17 AS INTEGER) AS z FROM events) s")
def mth05(t: Tables):
    return t("events").select((F.col("event_id") % 17).cast("int").alias("z")).distinct().select("z", F.round(geo.metres_per_pixel(F.col("z")), 6).alias("metres"))


@query(
    "mth06_haversine",
    f"WITH {EVENTS} SELECT event_id, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - 48.2) / 2), 2) + cos(radians(48.2)) * cos(radians(lat)) * pow(sin(radians(lon - 16.4) / 2), 2)))), 3) AS metres FROM ev",
)
def mth06(t: Tables):
    return event_points(t).select("event_id", F.round(geo.haversine_m(F.lit(16.4), F.lit(48.2), F.col("lon"), F.col("lat")), 3).alias("metres"))


@query(
    "mth07_zoom_of_bounds",
    f"WITH {EVENTS} SELECT event_id, round(greatest(0.0, -log2(greatest(wx / 100, wy / 64) + 0.000001)), 6) AS zoom FROM ev",
)
def mth07(t: Tables):
    zero = F.lit(0.0)
    return event_points(t).select("event_id", F.round(geo.zoom_of_bounds(zero, zero, F.col("wx") / 100 + 0.000001, F.col("wy") / 64 + 0.000001), 6).alias("zoom"))


@query("mth08_zigzag", "SELECT event_id, xor(v << 1, v >> 31) AS code, v AS back FROM (SELECT event_id, CAST(event_id % 4001 - 2000 AS INTEGER) AS v FROM events) s".replace("xor(v << 1, v >> 31)", "CAST(CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS INTEGER)"))
def mth08(t: Tables):
    v = t("events").select("event_id", (F.col("event_id") % 4001 - 2000).cast("int").alias("v"))
    return v.select("event_id", geo.zigzag(F.col("v")).alias("code")).select("*", geo.unzigzag(F.col("code")).alias("back"))


@query("mth09_units", "SELECT event_id, round(value * 3.28084, 6) AS ft, round(value * 0.000621371, 9) AS mi, round(value * 0.001, 6) AS km, round(value / 1852.0, 9) AS nmi, round(value / 256, 9) AS z0_px, round(value * 0.000247105, 9) AS acres FROM events")
def mth09(t: Tables):
    v = F.col("value")
    return t("events").select(
        "event_id", F.round(geo.in_unit(v, "ft"), 6).alias("ft"), F.round(geo.in_unit(v, "mi"), 9).alias("mi"), F.round(geo.in_unit(v, "km"), 6).alias("km"),
        F.round(geo.in_unit(v, "nmi"), 9).alias("nmi"), F.round(geo.in_unit(v, "z0_px"), 9).alias("z0_px"), F.round(v * geo.AREA_UNITS["ac"], 9).alias("acres"),
    )


@query(
    "mth10_quantise",
    "SELECT event_id, least(99, CAST(floor(v / 500 * 100) AS INTEGER)) AS level, least(49, CAST(floor((ln(v + 1) - ln(1)) / (ln(1000) - ln(1)) * 50) AS INTEGER)) AS log_level FROM (SELECT event_id, least(value, 499.5) AS v FROM events) s",
)
def mth10(t: Tables):
    v = t("events").select("event_id", F.least("value", F.lit(499.5)).alias("v"))
    return v.select("event_id", geo.level_of(F.col("v"), 0, 500, 100).alias("level"), geo.log_level_of(F.col("v") + 1, 1, 1000, 50).alias("log_level"))


@query("mth11_wrap", f"WITH {EVENTS} SELECT event_id, round((wx * 3 - 1) - floor(wx * 3 - 1), 9) AS wrapped FROM ev")
def mth11(t: Tables):
    return event_points(t).select("event_id", F.round(geo.wrap01(F.col("wx") * 3 - 1), 9).alias("wrapped"))


@query(
    "prj06_min_zoom_for_pixels",
    "SELECT event_id, CAST(least(greatest(ceil(log2(2.0 / ((value + 0.01) / 100000 * 256))), 0), 16) AS INTEGER) AS minzoom FROM events",
)
def prj06(t: Tables):
    return t("events").select("event_id", geo.min_zoom_for_pixels((F.col("value") + 0.01) / 100000, 2).alias("minzoom"))


@query("prj10_feature_ids", "SELECT id, id * 10 + 1 AS node_feature, id * 10 + 2 AS way_feature, id * 10 + 3 AS relation_feature, id AS plain FROM (SELECT DISTINCT id FROM osm_nodes WHERE id IS NOT NULL) s")
def prj10(t: Tables):
    ids = t("osm_nodes").filter("id is not null").select("id").distinct()
    return ids.select("id", *[geo.feature_id(F.col("id"), F.lit(k)).alias(f"{k}_feature") for k in ("node", "way", "relation")], geo.feature_id(F.col("id"), F.lit("node"), 1).alias("plain"))


@query(
    "geo17_mercator_metres",
    f"WITH {EVENTS} SELECT event_id, round(lon * (40075016.68557849 / 360), 3) AS mx, round((0.5 - wy) * 40075016.68557849, 3) AS my FROM ev",
)
def geo17(t: Tables):
    mx, my = geo.to_mercator_m(F.col("lon"), F.col("lat"))
    return event_points(t).select("event_id", F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"))


@query(
    "geo20_outcodes",
    f"WITH {EVENTS}, p AS (SELECT event_id, wx * 4 - 1 AS x, wy * 4 - 1 AS y FROM ev) SELECT event_id, CAST(CASE WHEN x < 0 THEN 1 WHEN x > 1 THEN 2 ELSE 0 END + CASE WHEN y < 0 THEN 4 WHEN y > 1 THEN 8 ELSE 0 END AS INTEGER) AS outcode FROM p",
)
def geo20(t: Tables):
    return event_points(t).select("event_id", geo.outcode(F.col("wx") * 4 - 1, F.col("wy") * 4 - 1, 0, 1).alias("outcode"))


# texts in many spellings, made from the values of the events
SPELLED = """SELECT event_id, CASE CAST(event_id % 16 AS INTEGER)
 WHEN 0 THEN v WHEN 1 THEN v || ' km' WHEN 2 THEN v || 'm' WHEN 3 THEN v || ' mi' WHEN 4 THEN i || '''6"' WHEN 5 THEN i || ' ft' WHEN 6 THEN i || '"' WHEN 7 THEN 'about ' || i
 WHEN 8 THEN '-' || v WHEN 9 THEN i WHEN 10 THEN '' WHEN 11 THEN 'no' WHEN 12 THEN NULL WHEN 13 THEN '-1' WHEN 14 THEN 'yes' ELSE '1,' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END AS s
FROM (SELECT event_id, CAST(CAST(round(value * 100) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS v, CAST(CAST(round(value * 100) AS BIGINT) // 100 AS VARCHAR) AS i FROM events) e"""


def spelled(t: Tables):
    cents = F.round(F.col("value") * 100).cast("bigint")
    whole = F.floor(cents / 100).cast("string")
    v = F.concat(whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    k = F.col("event_id") % 16
    made = [v, F.concat(v, F.lit(" km")), F.concat(v, F.lit("m")), F.concat(v, F.lit(" mi")), F.concat(whole, F.lit("'6\"")), F.concat(whole, F.lit(" ft")), F.concat(whole, F.lit('"')), F.concat(F.lit("about "), whole)]
    made += [F.concat(F.lit("-"), v), whole, F.lit(""), F.lit("no"), F.lit(None).cast("string"), F.lit("-1"), F.lit("yes")]
    case = F.when(k == 0, made[0])
    for n, m in enumerate(made[1:], 1):
        case = case.when(k == n, m)
    return t("events").select("event_id", case.otherwise(F.concat(F.lit("1,"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))).alias("s"))


LENIENT = "TRY_CAST(replace(regexp_extract(s, '^(-?[0-9][0-9,]*(?:\\.[0-9]*)?|-?\\.[0-9]+)', 1), ',', '') AS DOUBLE)"


@query(
    "prs01_numbers",
    f"SELECT event_id, coalesce(CASE WHEN regexp_matches(s, '^[+-]?[0-9]+$') THEN TRY_CAST(s AS BIGINT) END, CAST(trunc({LENIENT}) AS BIGINT)) AS as_long, {LENIENT} AS as_double, coalesce(CAST(trunc({LENIENT}) AS BIGINT), 0) AS or_zero FROM ({SPELLED}) q",
)
def prs01(t: Tables):
    s = F.col("s")
    return spelled(t).select("event_id", parse.long_or_null(s).alias("as_long"), parse.double_or_null(s).alias("as_double"), parse.long_or_zero(s).alias("or_zero"))


@query(
    "prs03_prefixes",
    f"SELECT event_id, TRY_CAST(nullif(regexp_extract(s, '^-?[0-9]+'), '') AS INTEGER) AS prefix, CAST(floor(CAST(TRY_CAST(nullif(regexp_extract(s, '^-?[0-9.]+'), '') AS FLOAT) AS DOUBLE) + 0.5) AS INTEGER) AS rounded FROM ({SPELLED}) q",
)
def prs03(t: Tables):
    return spelled(t).select("event_id", parse.int_prefix(F.col("s")).alias("prefix"), parse.rounded_int(F.col("s")).alias("rounded"))


@query("prs05_flags", f"SELECT event_id, coalesce(s, '') NOT IN ('', '0', 'false', 'no') AS flag, CAST(CASE WHEN s IN ('1', 'yes', 'true') THEN 1 WHEN s = '-1' THEN -1 ELSE 0 END AS INTEGER) AS direction FROM ({SPELLED}) q")
def prs05(t: Tables):
    return spelled(t).select("event_id", parse.flag(F.col("s")).alias("flag"), parse.direction(F.col("s")).alias("direction"))


@query(
    "prs07_road_order",
    """WITH tg AS (SELECT event_id, CAST(event_id % 7 - 3 AS VARCHAR) AS layer, (['motorway', 'trunk_link', 'primary', 'path', 'tertiary'])[CAST(event_id % 5 AS INTEGER) + 1] AS highway, event_id % 3 = 0 AS rail, CASE WHEN event_id % 4 = 0 THEN 'yes' ELSE 'no' END AS tunnel, CASE WHEN event_id % 9 = 0 THEN '1' ELSE '' END AS bridge FROM events)
SELECT event_id, CAST(CAST(layer AS BIGINT) * 10 + CASE highway WHEN 'motorway' THEN 9 WHEN 'trunk_link' THEN 3 WHEN 'primary' THEN 6 WHEN 'tertiary' THEN 4 ELSE CASE WHEN rail THEN 7 ELSE 0 END END
 - CASE tunnel WHEN 'yes' THEN 10 ELSE 0 END + CASE bridge WHEN '1' THEN 10 ELSE 0 END AS INTEGER) AS road_order FROM tg""",
)
def prs07(t: Tables):
    id_ = F.col("event_id")
    highway = F.get(F.array(*[F.lit(x) for x in ("motorway", "trunk_link", "primary", "path", "tertiary")]), (id_ % 5).cast("int"))
    tagmap = F.create_map(
        F.lit("layer"), (id_ % 7 - 3).cast("string"), F.lit("highway"), highway, F.lit("tunnel"), F.when(id_ % 4 == 0, "yes").otherwise("no"), F.lit("bridge"), F.when(id_ % 9 == 0, "1").otherwise("")
    )
    with_rail = F.when(id_ % 3 == 0, F.map_concat(tagmap, F.create_map(F.lit("railway"), F.lit("rail")))).otherwise(tagmap)
    return t("events").select("event_id", with_rail.alias("tags")).select("event_id", parse.road_order(F.col("tags")).alias("road_order"))


@query(
    "prs08_metres",
    """SELECT event_id, round(CASE CAST(event_id % 16 AS INTEGER) WHEN 0 THEN v WHEN 1 THEN v * 1000 WHEN 2 THEN v WHEN 3 THEN v * 1609.344 WHEN 4 THEN i * 0.3048 + 0.1524 WHEN 5 THEN i * 0.3048 WHEN 6 THEN i * 0.0254 WHEN 7 THEN i
 WHEN 8 THEN -v WHEN 9 THEN i WHEN 13 THEN -1 WHEN 15 THEN event_id % 1000 END, 6) AS metres
 FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) / 100.0 AS v, CAST(CAST(round(value * 100) AS BIGINT) // 100 AS DOUBLE) AS i FROM events) e""",
)
def prs08(t: Tables):
    return spelled(t).select("event_id", F.round(parse.metres(F.col("s")), 6).alias("metres"))


@query(
    "prs09_bandwidth",
    "SELECT event_id, CAST(round(k * CASE u WHEN 'kb/s' THEN 1000.0 WHEN 'Mbps' THEN 125000.0 WHEN 'GiB/s' THEN 1073741824.0 WHEN '' THEN 1.0 END, 3) AS DOUBLE) AS bytes_per_second FROM (SELECT event_id, event_id % 90 AS k, (['kb/s', 'Mbps', 'GiB/s', '', 'furlongs'])[CAST(event_id % 5 AS INTEGER) + 1] AS u FROM events) s",
)
def prs09(t: Tables):
    unit = F.get(F.array(*[F.lit(x) for x in ("kb/s", "Mbps", "GiB/s", "", "furlongs")]), (F.col("event_id") % 5).cast("int"))
    return t("events").select("event_id", F.round(parse.bandwidth(F.concat((F.col("event_id") % 90).cast("string"), F.lit(" "), unit)), 3).alias("bytes_per_second"))


@query("prs10_memory_sizes", "SELECT event_id, (event_id % 64) * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS bytes FROM events")
def prs10(t: Tables):
    unit = F.get(F.array(F.lit(""), F.lit("k"), F.lit("M"), F.lit("g")), (F.col("event_id") % 4).cast("int"))
    return t("events").select("event_id", parse.memory_size(F.concat((F.col("event_id") % 64).cast("string"), unit)).alias("bytes"))


@query("prs11_conversions", f"SELECT event_id, CASE WHEN s IS NOT NULL THEN s NOT IN ('', '0', 'false', 'no') END AS as_boolean, {LENIENT} AS as_double, CAST(trunc({LENIENT}) AS INTEGER) AS as_integer, s AS as_string FROM ({SPELLED}) q")
def prs11(t: Tables):
    return spelled(t).select("event_id", *[parse.convert(F.col("s"), k).alias(f"as_{k}") for k in ("boolean", "double", "integer", "string")])


@query(
    "str01_text_functions",
    "SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, substr(p_name, 3, 1) AS third, CAST(instr(p_name, 'a') - 1 AS INTEGER) AS first_a, CAST(CASE WHEN instr(reverse(p_name), 'a') = 0 THEN -1 ELSE length(p_name) - instr(reverse(p_name), 'a') END AS INTEGER) AS last_a, array_to_string(string_split(p_name, ' '), '-') AS joined, substr(p_name, 2, 4) AS part, replace(p_name, 'e', '_') AS replaced, CAST(len(string_split(p_type, ' ')) AS INTEGER) AS n_words FROM part",
)
def str01(t: Tables):
    n = F.col("p_name")
    return t("part").select(
        "p_partkey", F.lower(n).alias("lo"), F.upper(n).alias("up"), text.char_at(n, 2).alias("third"), text.index_of(n, "a").alias("first_a"), text.last_index_of(n, "a").alias("last_a"),
        F.array_join(F.split(n, " "), "-").alias("joined"), text.part_of(n, 1, 5).alias("part"), F.replace(n, F.lit("e"), F.lit("_")).alias("replaced"), F.size(F.split("p_type", " ")).alias("n_words"),
    )


@query("str02_regex_and_null", "SELECT p_partkey, regexp_replace(p_name, '([aeiou])([a-z])', '\\2\\1', 'g') AS swapped, coalesce(nullif(p_brand, 'Brand#11'), p_type) AS kept, nullif(trim(regexp_replace(p_name, '[a-z0-9#]', '', 'g')), '') AS rest FROM part")
def str02(t: Tables):
    return t("part").select(
        "p_partkey", F.regexp_replace("p_name", "([aeiou])([a-z])", "$2$1").alias("swapped"), F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), "p_type").alias("kept"),
        text.null_if_empty(F.trim(F.regexp_replace("p_name", "[a-z0-9#]", ""))).alias("rest"),
    )


LATIN = "a-zA-Zªºµ\\x{00C0}-\\x{00D6}\\x{00D8}-\\x{00F6}\\x{00F8}-\\x{024F}"


@query(
    "str06_latin",
    r"""WITH v AS (SELECT DISTINCT string_value AS s FROM layer_attrs WHERE string_value IS NOT NULL AND string_value <> '')
SELECT s, len(list_filter(string_split(s, ''), lambda c: regexp_matches(c, '\p{L}') AND NOT regexp_matches(c, '\p{Latin}'))) = 0 AS only_latin,
 CASE WHEN plain = s THEN trim(s) ELSE nullif(array_to_string(list_filter(string_split(translate(trim(replace(replace(replace(replace(plain, '()', ''), '( )', ''), '(  )', ''), '(-)', ''), ' ./-'), chr(9), ' '), ' '), lambda w: w <> ''), ' '), '') END AS rest
FROM (SELECT s, array_to_string(list_filter(string_split(s, ''), lambda c: NOT regexp_matches(c, '\p{Latin}')), '') AS plain FROM v) x""",
)
def str06(t: Tables):
    values = t("layer_attrs").filter("string_value is not null and string_value != ''").select(F.col("string_value").alias("s")).distinct()
    return values.select("s", text.only_latin(F.col("s")).alias("only_latin"), text.without_latin(F.col("s")).alias("rest"))


@query(
    "str08_language_tags",
    "WITH v AS (SELECT DISTINCT lang AS s FROM documents UNION SELECT 'name:' || lang FROM documents UNION SELECT lang || '-Latn' FROM documents) SELECT s, coalesce(regexp_matches(s, '^[a-z][A-Za-z]{1,2}(-[A-Za-z]{3}){0,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?$'), FALSE) AS language_tag, coalesce(starts_with(s, 'name:') AND regexp_matches(substr(s, 6), '^[a-z][A-Za-z]{1,2}(-[A-Za-z]{3}){0,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?$'), FALSE) AS name_tag FROM v",
)
def str08(t: Tables):
    lang = t("documents").select(F.col("lang").alias("s"))
    values = lang.unionByName(lang.select(F.concat(F.lit("name:"), "s").alias("s"))).unionByName(lang.select(F.concat("s", F.lit("-Latn")).alias("s"))).distinct()
    return values.select("s", text.language_tag(F.col("s")).alias("language_tag"), text.name_tag(F.col("s")).alias("name_tag"))


@query("str11_formats", "SELECT event_id, CAST(CAST(round(value % 1 * 100) AS INTEGER) AS VARCHAR) || '%' AS percent, CASE WHEN event_id < 1000 THEN CAST(event_id AS VARCHAR) ELSE regexp_replace(printf('%.1f', CAST(event_id AS DOUBLE) / 1000), '\\.0$', '') || 'k' END AS size FROM events")
def str11(t: Tables):
    return t("events").select("event_id", text.percent(F.col("value") % 1).alias("percent"), text.storage(F.col("event_id")).alias("size"))


@query(
    "map01_tag_access",
    "SELECT id, map_contains_key(tags, 'name') AS has_name, coalesce(tags['highway'] IN ('residential', 'footway'), FALSE) AS is_small, coalesce(tags['highway'], 'none') AS kind, coalesce(tags['name'], tags['highway']) AS label FROM (SELECT id, arg_max(tags, version) AS tags FROM osm_ways WHERE id IS NOT NULL AND tags IS NOT NULL GROUP BY id) s".replace("map_contains_key(tags, 'name')", "list_contains(map_keys(tags), 'name')"),
)
def map01(t: Tables):
    ways = t("osm_ways").filter("id is not null and tags is not null").groupBy("id").agg(F.max_by("tags", "version").alias("tags"))
    g = F.col("tags")
    return ways.select("id", tags.has(g, "name").alias("has_name"), tags.has(g, "highway", "residential", "footway").alias("is_small"), tags.get_or_default(g, "highway", F.lit("none")).alias("kind"), F.coalesce(tags.get(g, "name"), tags.get(g, "highway")).alias("label"))


@query("map03_merge", "SELECT event_id, 'a=' || event_type || ';b=' || CASE WHEN event_id % 2 = 0 THEN 'right' ELSE 'left' END || ';c=x' AS merged FROM events")
def map03(t: Tables):
    from terrane.plans.points import tags_text

    left = F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("left"))
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.lit("right"), F.lit("c"), F.lit("x"))).otherwise(F.create_map(F.lit("c"), F.lit("x")))
    return t("events").select("event_id", tags.merged(left, right).alias("m")).select("event_id", tags_text(F.col("m")).alias("merged"))


@query(
    "jsn01_paths",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS absent, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 2 AS half FROM events",
)
def jsn01(t: Tables):
    v = F.parse_json("props")
    return t("events").select("event_id", tags.path(v, "$.k", "bigint").alias("k"), tags.path(v, "$.none", "string").alias("absent"), (tags.path(v, "$.k", "double") / 2).alias("half"))


@query("jsn02_coercion", f"SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS as_int, CAST(NULL AS BOOLEAN) AS as_boolean, '{{\"k\":' || json_extract_string(props, '$.k') || '}}' AS as_json FROM events")
def jsn02(t: Tables):
    v = F.parse_json("props")
    return t("events").select("event_id", tags.path(v, "$.k", "int").alias("as_int"), tags.path(v, "$.flag", "boolean").alias("as_boolean"), F.to_json(v).alias("as_json"))


@query(
    "arr02_collect_over_lists",
    "WITH o AS (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey} ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(list_transform(items, lambda i: i.p), ',') AS parts, items[2].p AS second, items[99].p AS beyond, CAST(list_min(list_transform(items, lambda i: i.p)) AS BIGINT) AS smallest FROM o",
)
def arr02(t: Tables):
    items = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")))).alias("items"))
    at = lambda k: F.get("items", F.lit(k))["p"]
    return items.select("l_orderkey", F.array_join(F.transform("items", lambda i: i["p"].cast("string")), ",").alias("parts"), at(1).alias("second"), at(98).alias("beyond"), F.array_min(F.transform("items", lambda i: i["p"])).alias("smallest"))


@query("agg22_list_extremes", "SELECT vec_id, list_min(embedding) AS low, list_max(embedding) AS high FROM embeddings")
def agg22(t: Tables):
    return t("embeddings").select("vec_id", F.array_min("embedding").alias("low"), F.array_max("embedding").alias("high"))


@query(
    "dat01_timestamps",
    "SELECT event_id, epoch_us(ts) // 1000 AS millis, make_timestamp(epoch_us(ts) // 1000 * 1000) AS to_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day_number, ts + INTERVAL 1 MONTH + INTERVAL 2 DAY AS later FROM events",
)
def dat01(t: Tables):
    ts = F.col("ts")
    millis = tags.epoch_millis(ts)
    plain = lambda c: c.cast("timestamp_ntz")
    return t("events").select(
        "event_id", millis.alias("millis"), plain(F.timestamp_millis(millis)).alias("to_ms"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_date(F.to_date(ts)).alias("day_number"),
        plain(tags.add_interval(ts, months=1, days=2)).alias("later"),
    )


@query(
    "srt04_sort_keys",
    "SELECT event_id, CAST((1 - CAST(event_type = 'purchase' AS INTEGER)) * 11000 + (10 - CAST(event_id % 11 AS INTEGER)) * 1000 + least(999, CAST(floor(least(value, 500) / 500 * 1000) AS INTEGER)) - 2097152 AS INTEGER) AS sort_key, CAST(-1 - ((1 - CAST(event_type = 'purchase' AS INTEGER)) * 11000 + (10 - CAST(event_id % 11 AS INTEGER)) * 1000 + least(999, CAST(floor(least(value, 500) / 500 * 1000) AS INTEGER)) - 2097152) AS INTEGER) AS reversed FROM events",
)
def srt04(t: Tables):
    from terrane.operators.tiling import descending

    key = SortKey().trues_first(F.col("event_type") == "purchase").ints((F.col("event_id") % 11).cast("int"), 10, 0).doubles(F.col("value"), 0, 500, 1000).get()
    return t("events").select("event_id", key.alias("sort_key"), descending(key).alias("reversed"))
