"""The queries of problems 1, 2, 3 and 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import hierarchy, orphans, proximity, schemadrift
from terrane.plans.registry import Tables, query

NEAR_M = 25.0

SQL_NEAR_WITHIN = r"""
WITH dedup AS (SELECT feature_id, any_value(lat) AS lat, any_value(lon) AS lon, any_value(centroid) AS centroid FROM geo_features GROUP BY feature_id),
read AS (SELECT feature_id, lat, lon, regexp_extract(centroid, '^\s*(?:[sS][rR][iI][dD]\s*=\s*[0-9]+\s*;)?\s*[pP][oO][iI][nN][tT]\s*(?:[zZ][mM]|[zZ]|[mM])?\s*\(\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s+([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)(?:\s+[-+0-9.eE]+)*\s*\)\s*$', ['x', 'y']) AS m FROM dedup),
num AS (SELECT feature_id, lat, lon, TRY_CAST(m.x AS DOUBLE) AS x, TRY_CAST(m.y AS DOUBLE) AS y FROM read),
chosen AS (SELECT feature_id, CASE WHEN x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 THEN x ELSE lon END AS lon, CASE WHEN x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 THEN y ELSE lat END AS lat FROM num),
pts AS MATERIALIZED (SELECT feature_id, lon, lat, CAST(floor(lat / 0.001) AS BIGINT) AS row FROM chosen WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
shifted AS (SELECT feature_id, lon, lat, row + d AS row FROM pts, (VALUES (-1), (0), (1)) v(d)),
near AS (SELECT a.feature_id AS key_a, b.feature_id AS key_b FROM pts a JOIN shifted b ON a.row = b.row AND a.feature_id < b.feature_id
  WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 25.0),
parts AS (SELECT zone_id, unnest(string_split_regex(regexp_replace(boundary_wkt, '^\s*(MULTI)?POLYGON\s*', ''), '\)\s*\)\s*,')) AS part FROM zones),
numbered AS (SELECT zone_id, part, row_number() OVER (PARTITION BY zone_id ORDER BY part) AS part_no FROM parts),
rings AS (SELECT zone_id, part_no, unnest(string_split_regex(part, '\)\s*,\s*\(')) AS ring, generate_subscripts(string_split_regex(part, '\)\s*,\s*\('), 1) AS ring_no FROM numbered),
vertex AS (SELECT zone_id, part_no, ring_no, unnest(string_split(regexp_replace(ring, '[()]', '', 'g'), ',')) AS v, generate_subscripts(string_split(regexp_replace(ring, '[()]', '', 'g'), ','), 1) AS k FROM rings),
xy AS (SELECT zone_id, part_no, ring_no, k, CAST(string_split(trim(v), ' ')[1] AS DOUBLE) AS x, CAST(string_split(trim(v), ' ')[2] AS DOUBLE) AS y FROM vertex),
edge AS MATERIALIZED (SELECT zone_id, part_no, ring_no, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM xy WINDOW w AS (PARTITION BY zone_id, part_no, ring_no ORDER BY k)),
box AS (SELECT zone_id, part_no, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM xy GROUP BY ALL),
cand AS (SELECT zone_id, part_no, feature_id, lon, lat FROM pts JOIN box ON lon BETWEEN bx0 AND bx1 AND lat BETWEEN by0 AND by1),
hits AS (SELECT c.zone_id, c.part_no, c.feature_id, ring_no, count(*) % 2 AS odd FROM cand c JOIN edge e ON c.zone_id = e.zone_id AND c.part_no = e.part_no
  WHERE x2 IS NOT NULL AND (y1 > lat) != (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL),
inside AS (SELECT zone_id, part_no, feature_id FROM hits GROUP BY ALL HAVING max(CASE WHEN ring_no = 1 THEN odd ELSE 0 END) = 1 AND sum(CASE WHEN ring_no > 1 THEN odd ELSE 0 END) = 0)
SELECT 'near' AS found_kind, key_a, key_b FROM near UNION ALL SELECT DISTINCT 'within', zone_id, feature_id FROM inside
"""

SQL_HIERARCHY = r"""
WITH RECURSIVE link AS (SELECT min(relation_id) AS parent, member_ref AS child FROM relation_members
  WHERE member_type = 'relation' AND lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) = 'subarea' AND relation_id IS NOT NULL AND member_ref IS NOT NULL GROUP BY member_ref),
node AS (SELECT parent AS id FROM link UNION SELECT child FROM link),
up AS (SELECT id AS start, id AS cur, 0 AS steps, [id] AS seen, FALSE AS closed FROM node
  UNION ALL SELECT start, parent, steps + 1, list_prepend(parent, seen), list_contains(seen, parent) FROM up JOIN link ON child = cur WHERE NOT closed),
ended AS (SELECT start, max_by(cur, steps) AS cur, max(steps) AS steps, max_by(seen, steps) AS seen, max_by(closed, steps) AS closed FROM up GROUP BY start),
told AS (SELECT *, list_slice(seen, 1, list_position(list_slice(seen, 2, len(seen)), cur)) AS ring FROM ended)
SELECT start AS node_id, CASE WHEN closed THEN list_min(ring) ELSE cur END AS root_id,
  CAST(CASE WHEN NOT closed THEN steps ELSE len(seen) - len(ring) - 1 END AS INTEGER) AS depth,
  CASE WHEN NOT closed THEN 'tree' WHEN list_contains(ring, start) THEN 'cycle' ELSE 'below_cycle' END AS standing,
  CASE WHEN closed THEN '' ELSE array_to_string(seen, '/') END AS node_path FROM told
"""

SQL_DESCENDANTS = SQL_HIERARCHY[: SQL_HIERARCHY.index("ended AS")].rstrip().rstrip(",") + " SELECT cur AS ancestor_id, start AS descendant_id, CAST(steps AS INTEGER) AS distance FROM up WHERE steps > 0 AND (NOT closed OR cur = start)"

SQL_CHANGES = r"""
WITH files AS (SELECT file_id, arg_min(struct_pack(d := dataset, p := published_at, v := version, c := primary_column, e := lower(encoding), g := list_sort(list_distinct(coalesce(geometry_types, [])))), loaded_at) AS f FROM geo_files GROUP BY file_id),
ordered AS (SELECT file_id, f.v AS v, f.c AS c, f.e AS e, f.g AS g, lag(file_id) OVER w AS former, lag(f.v) OVER w AS v0, lag(f.e) OVER w AS e0, lag(f.g) OVER w AS g0 FROM files WINDOW w AS (PARTITION BY f.d ORDER BY f.p NULLS FIRST, file_id)),
later AS (SELECT * FROM ordered WHERE former IS NOT NULL),
rows1 AS (SELECT row_id, any_value(file_id) AS file_id, any_value(feature_id) AS feature_id, any_value(record) AS record FROM file_rows GROUP BY row_id),
vals AS (SELECT file_id, feature_id, j.key AS field, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'decimal' ELSE 'integer' END AS type,
  CASE j.type WHEN 'VARCHAR' THEN 's' || (j.value ->> '$') WHEN 'BOOLEAN' THEN 'b' || (j.value ->> '$') WHEN 'ARRAY' THEN 'j' || CAST(j.value AS VARCHAR) WHEN 'OBJECT' THEN 'j' || CAST(j.value AS VARCHAR) ELSE 's' || (j.value ->> '$') END AS text
  FROM rows1, json_each(record) j WHERE j.type != 'NULL' AND j.key != 'id'),
counted AS (SELECT file_id, field, type, count(*) AS n FROM vals GROUP BY ALL),
main AS (SELECT file_id, field, arg_max(type, n * 10 - list_position(['string', 'integer', 'decimal', 'boolean', 'list', 'object'], type)) AS type FROM counted GROUP BY ALL),
now AS (SELECT l.file_id, l.former, field, type FROM later l JOIN main m ON m.file_id = l.file_id),
was AS (SELECT l.file_id, l.former, field, type FROM later l JOIN main m ON m.file_id = l.former),
sides AS (SELECT coalesce(n.file_id, w.file_id) AS file_id, coalesce(n.former, w.former) AS former, coalesce(n.field, w.field) AS field, n.type AS new_type, w.type AS old_type FROM now n FULL JOIN was w ON n.file_id = w.file_id AND n.field = w.field),
fresh AS (SELECT * FROM sides WHERE old_type IS NULL), lost AS (SELECT * FROM sides WHERE new_type IS NULL),
shares AS (SELECT f.file_id, f.field AS new_name, o.field AS old_name, count(*) AS n, count(*) FILTER (WHERE a.text = b.text) AS same
  FROM fresh f JOIN lost o ON f.file_id = o.file_id JOIN vals a ON a.file_id = f.file_id AND a.field = f.field JOIN vals b ON b.file_id = o.former AND b.field = o.field AND a.feature_id = b.feature_id GROUP BY ALL),
good AS (SELECT *, row_number() OVER (PARTITION BY file_id, new_name ORDER BY same / n DESC, n DESC, old_name) AS ra, row_number() OVER (PARTITION BY file_id, old_name ORDER BY same / n DESC, n DESC, new_name) AS rb FROM shares WHERE same >= 0.6 * n),
ren AS (SELECT file_id, new_name, old_name FROM good WHERE ra = 1 AND rb = 1)
SELECT file_id, 'added' AS change_kind, field AS field_name, '' AS old_name FROM fresh WHERE (file_id, field) NOT IN (SELECT (file_id, new_name) FROM ren)
UNION ALL SELECT file_id, 'removed', field, '' FROM lost WHERE (file_id, field) NOT IN (SELECT (file_id, old_name) FROM ren)
UNION ALL SELECT file_id, 'renamed', new_name, old_name FROM ren
UNION ALL SELECT file_id, 'retyped', field, '' FROM sides WHERE new_type != old_type
UNION ALL SELECT r.file_id, 'retyped', new_name, '' FROM ren r JOIN fresh f ON f.file_id = r.file_id AND f.field = new_name JOIN lost o ON o.file_id = r.file_id AND o.field = old_name WHERE f.new_type != o.old_type
UNION ALL SELECT file_id, 'version', coalesce(c, ''), '' FROM later WHERE v IS DISTINCT FROM v0
UNION ALL SELECT file_id, 'encoding', coalesce(c, ''), '' FROM later WHERE e IS DISTINCT FROM e0
UNION ALL SELECT file_id, 'geometry_types', coalesce(c, ''), '' FROM later WHERE g IS DISTINCT FROM g0
"""

SQL_TABLE = SQL_CHANGES[: SQL_CHANGES.rindex("SELECT file_id, 'added'")].replace("WITH files", "WITH RECURSIVE files") + r""",
event AS (SELECT file_id, 'added' AS kind, field AS field_name, '' AS old_name FROM fresh WHERE (file_id, field) NOT IN (SELECT (file_id, new_name) FROM ren) UNION ALL SELECT file_id, 'renamed', new_name, old_name FROM ren),
placed AS (SELECT file_id, f.d AS dataset, row_number() OVER (PARTITION BY f.d ORDER BY f.p NULLS FIRST, file_id) AS place FROM files),
touched AS (SELECT dataset, place, field_name AS name, CASE kind WHEN 'renamed' THEN old_name END AS came_from FROM event JOIN placed USING (file_id)
  UNION ALL SELECT dataset, place, old_name, NULL FROM event JOIN placed USING (file_id) WHERE kind = 'renamed'),
seen AS (SELECT DISTINCT c.file_id, c.field, p.dataset, p.place FROM counted c JOIN placed p USING (file_id)),
back AS (SELECT file_id, field, dataset, place, field AS name FROM seen
  UNION ALL SELECT file_id, field, dataset, place, name FROM (SELECT b.file_id, b.field, b.dataset, t.place - 1 AS place, t.came_from AS name, t.place AS event_place, max(t.place) OVER w AS latest
    FROM back b JOIN touched t ON t.dataset = b.dataset AND t.name = b.name AND t.place <= b.place WINDOW w AS (PARTITION BY b.file_id, b.field)) x WHERE event_place = latest AND name IS NOT NULL),
origin AS (SELECT file_id, field, any_value(dataset) AS dataset, arg_min(name, place) AS field_name FROM back GROUP BY ALL),
kinds AS (SELECT dataset, field_name, list(DISTINCT type) AS k FROM counted JOIN origin USING (file_id, field) GROUP BY ALL),
canon AS (SELECT dataset, field_name, CASE WHEN len(k) = 1 THEN k[1] WHEN list_has_all(['integer', 'decimal'], k) THEN 'decimal' ELSE 'string' END AS canonical_type FROM kinds),
raw AS (SELECT v.file_id, v.feature_id, v.field, v.type, substr(v.text, 2) AS text FROM vals v)
SELECT o.dataset, r.file_id, r.feature_id, o.field_name, r.field AS source_field, r.type AS type_tag, CASE WHEN r.type = 'string' THEN text END AS v_string, CASE WHEN r.type = 'boolean' THEN CAST(text AS BOOLEAN) END AS v_boolean,
  CASE WHEN r.type = 'integer' THEN TRY_CAST(text AS BIGINT) END AS v_integer, CASE WHEN r.type = 'integer' AND TRY_CAST(text AS BIGINT) IS NULL THEN text END AS v_big_integer, CASE WHEN r.type = 'decimal' THEN CAST(text AS DOUBLE) END AS v_decimal,
  CASE WHEN r.type IN ('list', 'object') THEN text END AS v_json, canonical_type,
  CASE r.type WHEN 'decimal' THEN regexp_replace(regexp_replace(text, '(\.[0-9]*?)0+$', '\1'), '\.$', '')
    WHEN 'object' THEN '{' || (SELECT string_agg('"' || key || '":' || CAST(value AS VARCHAR), ',' ORDER BY key) FROM json_each(CASE WHEN r.type = 'object' THEN text END)) || '}' ELSE text END AS canonical,
  CASE WHEN r.type = canonical_type THEN 'kept' ELSE 'converted' END AS conversion
FROM raw r JOIN origin o ON o.file_id = r.file_id AND o.field = r.field JOIN canon c ON c.dataset = o.dataset AND c.field_name = o.field_name
"""

SQL_ALTERNATIVES = r"""
WITH files AS (SELECT file_id, arg_min(struct_pack(d := dataset, p := published_at), loaded_at) AS f FROM geo_files GROUP BY file_id),
placed AS (SELECT file_id, f.d AS dataset, row_number() OVER (PARTITION BY f.d ORDER BY f.p NULLS FIRST, file_id) AS place FROM files),
rows1 AS (SELECT row_id, any_value(file_id) AS file_id, any_value(record) AS record FROM file_rows GROUP BY row_id),
tree AS (SELECT file_id, regexp_replace(regexp_replace(regexp_replace(fullkey, '\[[0-9]+\]', '[]', 'g'), '"', '', 'g'), '^\$\.', '') AS path,
  CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'decimal' ELSE 'integer' END AS type
  FROM rows1, json_tree(record) WHERE fullkey != '$' AND type != 'NULL' AND fullkey != '$.id' AND fullkey NOT LIKE '$.id.%' AND fullkey NOT LIKE '$.id[%'),
fused AS (SELECT file_id, path, type, count(*) AS n FROM tree GROUP BY ALL)
SELECT dataset, path, type, arg_min(file_id, place) AS file_id, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_values FROM fused JOIN placed USING (file_id) GROUP BY ALL
"""

SQL_JUDGED = r"""
WITH nodes AS (SELECT id, NOT coalesce(max_by(visible, version), TRUE) AS gone, min(loaded_at) AS first_loaded FROM osm_nodes GROUP BY id),
rels AS (SELECT id, NOT coalesce(max_by(visible, version), TRUE) AS gone, min(loaded_at) AS first_loaded FROM osm_relations GROUP BY id),
way AS (SELECT id, min(loaded_at) AS loaded_at, min(edited_at) AS edited_at, any_value(node_ids) AS node_ids FROM osm_ways GROUP BY id),
wref AS (SELECT DISTINCT id AS from_id, unnest(node_ids) AS ref_id, loaded_at, edited_at FROM way),
mref AS (SELECT membership_id AS from_id, any_value(relation_id) AS ref_id, min(loaded_at) AS loaded_at, min(edited_at) AS edited_at FROM relation_members GROUP BY membership_id),
judged AS (SELECT 'osm_ways' AS ref_table, from_id, ref_id, r.loaded_at, edited_at, CASE WHEN n.id IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN first_loaded > r.loaded_at THEN 'late' END AS reason FROM wref r LEFT JOIN nodes n ON n.id = ref_id WHERE ref_id IS NOT NULL
  UNION ALL SELECT 'relation_members', from_id, ref_id, r.loaded_at, edited_at, CASE WHEN n.id IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN first_loaded > r.loaded_at THEN 'late' END FROM mref r LEFT JOIN rels n ON n.id = ref_id WHERE ref_id IS NOT NULL)
"""

SQL_ORPHANS = SQL_JUDGED + "SELECT ref_table, from_id, ref_id, reason FROM judged WHERE reason IS NOT NULL"

SQL_ORPHANS_BY_MONTH = SQL_JUDGED + "SELECT ref_table, strftime(coalesce(edited_at, loaded_at), '%Y-%m') AS month, reason, count(*) AS n_references, count(DISTINCT ref_id) AS n_targets FROM judged WHERE reason IS NOT NULL GROUP BY ALL"


@query("p1_found", SQL_NEAR_WITHIN)
def p1_found(t: Tables):
    features = t("geo_features")
    zones = t("zones").select(F.col("zone_id").alias("region"), F.col("boundary_wkt").alias("wkt"))
    share = lambda fraction: proximity.places(features.sample(fraction=fraction, seed=7))
    return proximity.near_and_within(proximity.places(features), zones, NEAR_M, rows=features.count(), sampler=share)


def _subareas(t: Tables):
    role = F.lower(F.regexp_replace("role", r"^\s+|\s+$", ""))
    return t("relation_members").filter((F.col("member_type") == "relation") & (role == "subarea")).select(F.col("relation_id").alias("parent"), F.col("member_ref").alias("child"))


@query("p2_found", SQL_HIERARCHY)
def p2_found(t: Tables):
    rows = hierarchy.hierarchies(_subareas(t))
    path = F.when(F.col("standing") == "tree", F.array_join(F.transform("path", lambda x: x.cast("string")), "/")).otherwise("")
    return rows.select("node_id", "root_id", "depth", "standing", path.alias("node_path"))


@query("p2_descendants", SQL_DESCENDANTS)
def p2_descendants(t: Tables):
    return hierarchy.all_descendants(_subareas(t))


@query("p3_found", SQL_CHANGES)
def p3_found(t: Tables):
    return schemadrift.all_changes(t("geo_files"), t("file_rows"))


@query("p3_table", SQL_TABLE)
def p3_table(t: Tables):
    return schemadrift.consistent_table(t("geo_files"), t("file_rows"))


@query("p3_alternatives", SQL_ALTERNATIVES)
def p3_alternatives(t: Tables):
    return schemadrift.appearing_alternatives(t("geo_files"), t("file_rows"))


def _orphans(t: Tables):
    return orphans.all_orphans(t("osm_nodes"), t("osm_ways"), t("osm_relations"), t("relation_members"))


@query("p5_found", SQL_ORPHANS)
def p5_found(t: Tables):
    return _orphans(t).select("ref_table", "from_id", "ref_id", "reason")


@query("p5_by_month", SQL_ORPHANS_BY_MONTH)
def p5_by_month(t: Tables):
    month = F.date_format(F.coalesce("edited_at", "loaded_at"), "yyyy-MM")
    return _orphans(t).groupBy("ref_table", month.alias("month"), "reason").agg(F.count("*").alias("n_references"), F.count_distinct("ref_id").alias("n_targets"))
