"""Queries of tiling, label limits, orders and archive layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators import stats, tiling
from terrane.plans.points import EVENTS, event_points
from terrane.plans.registry import Tables, query

BUFFER = "({b} / 256.0 + 0.1 / 4096)"
#: Events on tiles of zooms 0 to 6 with a buffer of 32 pixels, in SQL.
ON_TILES = f"""{EVENTS}, zoomed AS (SELECT *, unnest(generate_series(0, 6)) AS z FROM ev), scaled AS (SELECT *, wx * pow(2, z) AS sx, wy * pow(2, z) AS sy, CAST(pow(2, z) AS BIGINT) AS n FROM zoomed),
cols AS (SELECT *, unnest(generate_series(CAST(floor(sx - {BUFFER.format(b=32.0)}) AS BIGINT), CAST(floor(sx + {BUFFER.format(b=32.0)}) AS BIGINT))) AS cx FROM scaled),
cells AS (SELECT *, unnest(generate_series(greatest(CAST(floor(sy - {BUFFER.format(b=32.0)}) AS BIGINT), 0), least(CAST(floor(sy + {BUFFER.format(b=32.0)}) AS BIGINT), n - 1))) AS ty FROM cols),
tiles AS (SELECT event_id, event_type, value, wx, wy, sx, sy, n, CAST(z AS INTEGER) AS z, ((cx % n) + n) % n AS tx, ty, (sx - cx) * 256 AS px, (sy - ty) * 256 AS py FROM cells)"""


def events_on_tiles(t: Tables, buffer_px: float = 32.0):
    zoomed = tiling.explode_zooms(event_points(t), 0, 6)
    return tiling.point_tiles(zoomed, buffer_px)


@query("til01_zooms", "SELECT event_id, unnest(generate_series(event_id % 5, event_id % 9)) AS z FROM events".replace("AS z", "AS zz").join(["SELECT event_id, CAST(zz AS INTEGER) AS z FROM (", ") s"]))
def til01(t: Tables):
    return tiling.explode_zooms(t("events").select("event_id"), (F.col("event_id") % 5).cast("int"), (F.col("event_id") % 9).cast("int"))


@query("til02_point_tiles", f"WITH {ON_TILES} SELECT event_id, z, tx, ty FROM tiles")
def til02(t: Tables):
    return events_on_tiles(t).select("event_id", "z", "tx", "ty")


@query("til07_tile_pixels", f"WITH {ON_TILES} SELECT event_id, z, tx, ty, round(px, 5) AS px, round(py, 5) AS py FROM tiles WHERE z = 5")
def til07(t: Tables):
    return events_on_tiles(t).filter("z = 5").select("event_id", "z", "tx", "ty", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"))


@query(
    "til06_box_tiles",
    f"WITH {EVENTS}, box AS (SELECT event_id, unnest(generate_series(3, 7)) AS z, greatest(wx - value / 5000, 0) AS a, wy - value / 5000 AS b, least(wx + value / 5000, 1) AS c, wy + value / 5000 AS d FROM ev), xs AS (SELECT *, unnest(generate_series(CAST(least(greatest(floor(a * pow(2, z)), 0), pow(2, z) - 1) AS BIGINT), CAST(least(greatest(floor(c * pow(2, z)), 0), pow(2, z) - 1) AS BIGINT))) AS tx FROM box) SELECT event_id, CAST(z AS INTEGER) AS z, tx, unnest(generate_series(CAST(least(greatest(floor(b * pow(2, z)), 0), pow(2, z) - 1) AS BIGINT), CAST(least(greatest(floor(d * pow(2, z)), 0), pow(2, z) - 1) AS BIGINT))) AS ty FROM xs",
)
def til06(t: Tables):
    r = F.col("value") / 5000
    boxes = event_points(t).select("event_id", F.greatest(F.col("wx") - r, F.lit(0.0)).alias("minx"), (F.col("wy") - r).alias("miny"), F.least(F.col("wx") + r, F.lit(1.0)).alias("maxx"), (F.col("wy") + r).alias("maxy"))
    return tiling.box_tiles(tiling.explode_zooms(boxes, 3, 7)).select("event_id", "z", "tx", "ty")


GRID = "CASE WHEN 32 / 256.0 >= 1 / 4096.0 THEN (CAST(floor(sx / (32 / 256.0)) AS BIGINT) << 32) | (CAST(floor(sy / (32 / 256.0)) AS BIGINT) & 4294967295) END"


@query("til08_label_grid", f"WITH {EVENTS}, s AS (SELECT event_id, wx * 64 AS sx, wy * 64 AS sy FROM ev WHERE wy BETWEEN 0 AND 1) SELECT event_id, {GRID} AS cell FROM s")
def til08(t: Tables):
    return event_points(t).filter("wy between 0 and 1").select("event_id", geo.label_grid_id(F.col("wx") * 64, F.col("wy") * 64, F.lit(32 / 256)).alias("cell"))


@query("til09_parents", f"WITH {EVENTS}, t AS (SELECT event_id, CAST(floor(wx * 256) AS BIGINT) AS x, CAST(floor(wy * 256) AS BIGINT) AS y FROM ev) SELECT event_id, 7 AS z, x // 2 AS x, CASE WHEN y >= 0 THEN y // 2 ELSE y // 2 END AS y, ((x - 300) % 256 + 256) % 256 AS wrapped FROM t WHERE y >= 0")
def til09(t: Tables):
    x, y = geo.tile_column(F.col("wx"), F.lit(8)), geo.tile_column(F.col("wy"), F.lit(8))
    tiles = event_points(t).select("event_id", x.alias("tx"), y.alias("ty")).filter("ty >= 0")
    return tiles.select("event_id", F.lit(7).alias("z"), F.shiftright("tx", 1).alias("x"), F.shiftright("ty", 1).alias("y"), F.pmod(F.col("tx") - 300, F.lit(256).cast("bigint")).alias("wrapped"))


@query("til11_point_commands", f"WITH {EVENTS}, t AS (SELECT event_id, CAST(floor((wx * 32 - floor(wx * 32)) * 4096 + 0.5) AS INTEGER) AS gx, CAST(floor((wy * 32 - floor(wy * 32)) * 4096 + 0.5) AS INTEGER) AS gy FROM ev) SELECT event_id, '9,' || (2 * gx) || ',' || (2 * gy) AS commands FROM t")
def til11(t: Tables):
    px, py = (F.col("wx") * 32 - F.floor(F.col("wx") * 32)) * 256, (F.col("wy") * 32 - F.floor(F.col("wy") * 32)) * 256
    return event_points(t).select("event_id", F.array_join(tiling.point_commands(px, py).cast("array<string>"), ",").alias("commands"))


LABELS = f"""{ON_TILES}, keyed AS (SELECT *, (CAST(floor(sx / 0.125) AS BIGINT) << 32) | (CAST(floor(sy / 0.125) AS BIGINT) & 4294967295) AS cell, CAST(least(999, CAST(floor((500 - least(500, value)) / 500 * 1000) AS INTEGER)) - 2097152 AS INTEGER) AS sort_key FROM tiles WHERE event_type IN ('purchase', 'signup')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY z, tx, ty, cell ORDER BY sort_key, event_id) AS rank FROM keyed), kept AS (SELECT * FROM ranked WHERE rank <= 3)"""


def labels(t: Tables):
    """Point labels on tiles, at most three per 32-pixel cell, dearest first."""
    chosen = event_points(t).filter(F.col("event_type").isin("purchase", "signup"))
    tiles = tiling.point_tiles(tiling.explode_zooms(chosen, 0, 6), 32.0)
    side = F.pow(F.lit(2.0), F.col("z"))
    key = tiling.SortKey().doubles(F.col("value"), 500, 0, 1000).get()
    keyed = tiles.withColumn("cell", geo.label_grid_id(F.col("wx") * side, F.col("wy") * side, F.lit(0.125))).withColumn("sort_key", key)
    return tiling.limit_per_cell(keyed, "cell", 3, ["z", "tx", "ty"], [F.col("sort_key"), F.col("event_id")])


@query("flagship_point_labels", f"WITH {LABELS} SELECT z, tx, ty, count(*) AS n, round(sum(value), 2) AS total, min(event_id) AS first_id, max(event_id) AS last_id FROM kept GROUP BY z, tx, ty")
def flagship(t: Tables):
    return labels(t).groupBy("z", "tx", "ty").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("win01_label_limit", f"WITH {LABELS} SELECT event_id, z, tx, ty, sort_key FROM kept")
def win01(t: Tables):
    return labels(t).select("event_id", "z", "tx", "ty", "sort_key")


@query("win02_label_rank", f"WITH {LABELS} SELECT event_id, z, tx, ty, CAST(rank AS INTEGER) AS rank FROM ranked WHERE z = 6 AND rank <= 5")
def win02(t: Tables):
    chosen = event_points(t).filter(F.col("event_type").isin("purchase", "signup")).withColumn("z", F.lit(6))
    keyed = tiling.point_tiles(chosen, 32.0).withColumn("cell", geo.label_grid_id(F.col("wx") * 64, F.col("wy") * 64, F.lit(0.125))).withColumn("sort_key", tiling.SortKey().doubles(F.col("value"), 500, 0, 1000).get())
    return stats.top_per_group(keyed, ["z", "tx", "ty", "cell"], [F.col("sort_key"), F.col("event_id")], 5).select("event_id", "z", "tx", "ty", "rank")


@query("win02_label_rank_all_zooms")
def win02_all(t: Tables):
    """Ranks of the five dearest of all events in each cell, on every zoom made."""
    side = F.pow(F.lit(2.0), F.col("z"))
    keyed = events_on_tiles(t).withColumn("cell", geo.label_grid_id(F.col("wx") * side, F.col("wy") * side, F.lit(0.125))).withColumn("sort_key", tiling.SortKey().doubles(F.col("value"), 500, 0, 1000).get())
    return stats.top_per_group(keyed, ["z", "tx", "ty", "cell"], [F.col("sort_key"), F.col("event_id")], 5).select("event_id", "z", "tx", "ty", "rank")


@query("agg01_by_tile", f"WITH {ON_TILES} SELECT z, tx, ty, count(*) AS n, count(DISTINCT event_type) AS n_types FROM tiles GROUP BY z, tx, ty")
def agg01(t: Tables):
    return events_on_tiles(t).groupBy("z", "tx", "ty").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("n_types"))


@query("agg02_by_layer_in_tile", f"WITH {ON_TILES} SELECT z, tx, ty, event_type AS layer, array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY event_id), ',') AS ids FROM tiles WHERE z >= 5 GROUP BY ALL")
def agg02(t: Tables):
    by = events_on_tiles(t).filter("z >= 5").groupBy("z", "tx", "ty", F.col("event_type").alias("layer")).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return by.select("z", "tx", "ty", "layer", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("agg14_emitted", f"WITH {ON_TILES} SELECT z, event_type AS layer, count(*) AS n FROM tiles GROUP BY z, event_type")
def agg14(t: Tables):
    return events_on_tiles(t).groupBy("z", F.col("event_type").alias("layer")).agg(F.count("*").alias("n"))


@query("flt16_bounds", f"WITH {EVENTS} SELECT event_id FROM ev WHERE lon BETWEEN -20 AND 40 AND lat BETWEEN 10 AND 60")
def flt16(t: Tables):
    return event_points(t).filter(F.col("lon").between(-20, 40) & F.col("lat").between(10, 60)).select("event_id")


@query("flt17_tile_ranges", f"WITH {ON_TILES} SELECT event_id, z, tx, ty FROM tiles WHERE tx >= floor(0.25 * n) AND tx < ceil(0.6 * n) AND ty >= floor(0.3 * n) AND ty < ceil(0.7 * n)")
def flt17(t: Tables):
    ranges = tiling.tile_ranges(0.25, 0.3, 0.6, 0.7, range(7))
    return events_on_tiles(t).filter(tiling.in_tile_ranges(F.col("z"), F.col("tx"), F.col("ty"), ranges)).select("event_id", "z", "tx", "ty")


@query("flt18_min_size", "SELECT event_id, z FROM (SELECT event_id, value / 1000000 AS size, unnest(generate_series(0, 10)) AS zz, CAST(zz AS INTEGER) AS z FROM events) s WHERE size * 256 * pow(2, z) >= 2".replace("unnest(generate_series(0, 10)) AS zz, CAST(zz AS INTEGER) AS z", "CAST(unnest(generate_series(0, 10)) AS INTEGER) AS z"))
def flt18(t: Tables):
    sized = tiling.explode_zooms(t("events").select("event_id", (F.col("value") / 1_000_000).alias("size")), 0, 10)
    return sized.filter(geo.pixel_size(F.col("size"), F.col("z")) >= 2).select("event_id", "z")


@query("flt20_point_buffer", f"WITH {ON_TILES} SELECT event_id, z, tx, ty FROM tiles WHERE px BETWEEN -8 AND 264 AND py BETWEEN -8 AND 264")
def flt20(t: Tables):
    return events_on_tiles(t).filter(tiling.within_buffer(F.col("px"), F.col("py"), 8)).select("event_id", "z", "tx", "ty")


@query("flt21_skip_fills", "SELECT tile_id FROM layer_attrs WHERE tile_id IS NOT NULL GROUP BY tile_id HAVING NOT bool_and(coalesce(layer, '') IN ('water', 'landcover'))")
def flt21(t: Tables):
    fills = F.coalesce("layer", F.lit("")).isin("water", "landcover")
    return t("layer_attrs").filter("tile_id is not null").groupBy("tile_id").agg(F.bool_and(fills).alias("fill")).filter("not fill").select("tile_id")


@query("flt22_layer_choice", "SELECT id, minzoom, maxzoom FROM vector_layers WHERE id IN ('building', 'place', 'water', 'poi') AND id NOT IN ('poi')")
def flt22(t: Tables):
    from terrane.rules.ast import chosen_layers

    every = [r[0] for r in t("vector_layers").select("id").collect()]  # the layers of one map
    return t("vector_layers").filter(F.col("id").isin(chosen_layers(every, only=["building", "place", "water", "poi"], exclude=["poi"]))).select("id", "minzoom", "maxzoom")


CONTENT = "content AS (SELECT tile_id, string_agg(coalesce(layer, '') || '/' || coalesce(field_name, ''), ',' ORDER BY coalesce(layer, '') || '/' || coalesce(field_name, '')) AS content FROM (SELECT DISTINCT tile_id, layer, field_name FROM layer_attrs WHERE tile_id IS NOT NULL) d GROUP BY tile_id)"


def tile_contents(t: Tables):
    one = t("layer_attrs").filter("tile_id is not null").select("tile_id", F.concat(F.coalesce("layer", F.lit("")), F.lit("/"), F.coalesce("field_name", F.lit(""))).alias("k")).distinct()
    return one.groupBy("tile_id").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("content"))


@query("agg16_tile_dedupe", f"WITH {CONTENT} SELECT tile_id, min(tile_id) OVER (PARTITION BY content) AS first_tile, count(*) OVER (PARTITION BY content) AS copies, CAST(length(content) AS INTEGER) AS length FROM content")
def agg16(t: Tables):
    return stats.deduplicated(tile_contents(t)).select("tile_id", "first_tile", "copies", "length")


@query("snk03_compact_tables", f"WITH {CONTENT}, f AS (SELECT content, min(tile_id) AS first_tile FROM content GROUP BY content), d AS (SELECT *, row_number() OVER (ORDER BY first_tile) - 1 AS data_id FROM f) SELECT tile_id, data_id FROM content JOIN d USING (content)")
def snk03(t: Tables):
    from terrane.sinks.archives import compact

    return compact(tile_contents(t))[0]


@query("join16_compact_view", f"WITH {CONTENT} SELECT tile_id, content FROM content")
def join16(t: Tables):
    from terrane.sinks.archives import compact

    shallow, data = compact(tile_contents(t))
    return shallow.join(data, "data_id").select("tile_id", "content")


DIRECTORY = f"""{CONTENT}, f AS (SELECT *, min(tile_id) OVER (PARTITION BY content) AS first_tile FROM content), o AS (SELECT first_tile, sum(len) OVER (ORDER BY first_tile ROWS UNBOUNDED PRECEDING) - len AS byte_offset, len FROM (SELECT first_tile, any_value(length(content)) AS len FROM f GROUP BY first_tile) q)"""


@query("win05_offsets", f"WITH {DIRECTORY} SELECT tile_id, CAST(byte_offset AS BIGINT) AS byte_offset, CAST(len AS INTEGER) AS length FROM f JOIN o USING (first_tile)")
def win05(t: Tables):
    d = stats.deduplicated(tile_contents(t))
    firsts = d.select("first_tile", "length").distinct()
    return d.select("tile_id", "first_tile").join(stats.offsets(firsts), "first_tile").select("tile_id", F.col("offset").alias("byte_offset"), "length")


@query(
    "win04_run_lengths",
    f"WITH {EVENTS}, tile AS (SELECT DISTINCT CAST(floor(wx * 256) AS BIGINT) * 256 + CAST(floor(wy * 256) AS BIGINT) AS id, event_type FROM ev WHERE wy BETWEEN 0 AND 0.999), g AS (SELECT *, id - row_number() OVER (PARTITION BY event_type ORDER BY id) AS island FROM tile) SELECT event_type, min(id) AS first, count(*) AS length FROM g GROUP BY event_type, island",
)
def win04(t: Tables):
    id_ = geo.tile_column(F.col("wx"), F.lit(8)) * 256 + geo.tile_column(F.col("wy"), F.lit(8))
    return tiling.runs(event_points(t).filter("wy between 0 and 0.999").select(id_.alias("id"), "event_type").distinct(), "id", ["event_type"])


@query("win03_same_as_before", f"WITH {CONTENT} SELECT tile_id, coalesce(content = lag(content) OVER (PARTITION BY tile_id // 1000 ORDER BY tile_id), FALSE) AS same FROM content")
def win03(t: Tables):
    by = Window.partitionBy(F.floor(F.col("tile_id") / 1000)).orderBy("tile_id")
    return tile_contents(t).select("tile_id", F.coalesce(F.col("content") == F.lag("content").over(by), F.lit(False)).alias("same"))


@query(
    "prj08_line_ranges",
    """WITH r AS (SELECT l_orderkey, least(l_quantity, 50 - l_quantity) / 50 AS start_at, greatest(l_quantity, 50 - l_quantity) / 50 AS end_at, l_linenumber AS priority, l_returnflag || CAST(l_linenumber AS VARCHAR) AS attr FROM lineitem),
p AS (SELECT DISTINCT l_orderkey, at_ FROM (SELECT l_orderkey, unnest([start_at, end_at, 0.0, 1.0]) AS at_ FROM r) x), s AS (SELECT l_orderkey, at_, lead(at_) OVER (PARTITION BY l_orderkey ORDER BY at_) AS until FROM p),
c AS (SELECT s.l_orderkey, at_, until, coalesce(string_agg(attr, ',' ORDER BY priority, attr), '') AS attrs FROM (SELECT * FROM s WHERE until IS NOT NULL) s LEFT JOIN r ON r.l_orderkey = s.l_orderkey AND start_at <= at_ AND end_at >= until GROUP BY ALL),
m AS (SELECT *, CASE WHEN attrs = lag(attrs) OVER w THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY at_)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY at_) AS run FROM m)
SELECT l_orderkey, round(min(at_), 6) AS start_at, round(max(until), 6) AS end_at, any_value(attrs) AS attrs FROM g GROUP BY l_orderkey, run""",
)
def prj08(t: Tables):
    q = F.col("l_quantity")
    ranges = t("lineitem").select("l_orderkey", (F.least(q, 50 - q) / 50).alias("start_at"), (F.greatest(q, 50 - q) / 50).alias("end_at"), F.col("l_linenumber").alias("priority"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("attr"))
    return tiling.line_overlay(ranges, ["l_orderkey"]).select("l_orderkey", F.round("start_at", 6).alias("start_at"), F.round("end_at", 6).alias("end_at"), "attrs")


@query("srt01_tile_order", f"WITH {ON_TILES} SELECT z, tx, ty, event_id, row_number() OVER (PARTITION BY z ORDER BY tx, n - 1 - ty, event_id) AS place FROM tiles WHERE z BETWEEN 3 AND 4")
def srt01(t: Tables):
    """Places in tile-id order; ranges of the id are sorted in parallel and the ranks added up."""
    tiles = events_on_tiles(t).filter("z between 3 and 4").withColumn("tid", geo.tile_id(F.col("z"), F.col("tx"), F.col("ty")))
    counts = tiles.groupBy("z", "tx").agg(F.count("*").alias("n"))
    before = counts.select("z", "tx", (F.sum("n").over(Window.partitionBy("z").orderBy("tx")) - F.col("n")).alias("before"))  # one row per tile column
    inside = F.row_number().over(Window.partitionBy("z", "tx").orderBy("tid", "event_id"))
    return tiles.withColumn("inside", inside).join(before, ["z", "tx"]).select("z", "tx", "ty", "event_id", (F.col("before") + F.col("inside")).alias("place"))


@query("srt01_tile_order_all_zooms")
def srt01_all(t: Tables):
    """The same order on every zoom made; tiles are cut into ranges of ids, since all events share the one tile of zoom 0."""
    cut = F.floor(F.col("event_id") / 65_536)
    tiles = events_on_tiles(t).withColumn("tid", geo.tile_id(F.col("z"), F.col("tx"), F.col("ty"))).withColumn("cut", cut)
    counts = tiles.groupBy("z", "tid", "cut").agg(F.count("*").alias("n"))
    before = counts.select("z", "tid", "cut", (F.sum("n").over(Window.partitionBy("z").orderBy("tid", "cut")) - F.col("n")).alias("before"))  # one row per tile and range
    inside = F.row_number().over(Window.partitionBy("z", "tid", "cut").orderBy("event_id"))
    return tiles.withColumn("inside", inside).join(before, ["z", "tid", "cut"]).select("z", "tx", "ty", "event_id", (F.col("before") + F.col("inside")).alias("place"))


@query("srt06_hilbert_order", f"WITH {EVENTS}, c AS (SELECT event_id, event_type, CAST(floor(wx * 32768) AS BIGINT) AS x, CAST(floor(wy * 32768) AS BIGINT) AS y FROM ev WHERE wy BETWEEN 0 AND 0.9999), h AS (SELECT event_id, event_type, {geo.hilbert_sql(15, 'x', 'y')} AS h FROM c) SELECT event_id, h AS hilbert, CAST(row_number() OVER (PARTITION BY event_type, event_id % 50 ORDER BY h, event_id) AS INTEGER) AS place FROM h")
def srt06(t: Tables):
    at = event_points(t).filter("wy between 0 and 0.9999").withColumn("hilbert", geo.hilbert_index(15, geo.tile_column(F.col("wx"), F.lit(15)), geo.tile_column(F.col("wy"), F.lit(15))))
    return at.select("event_id", "hilbert", F.row_number().over(Window.partitionBy("event_type", F.col("event_id") % 50).orderBy("hilbert", "event_id")).alias("place"))


@query("snk05_tile_paths", f"WITH {EVENTS}, tl AS (SELECT event_id, CAST(floor(wx * 16384) AS BIGINT) AS x, CAST(floor(wy * 16384) AS BIGINT) AS y FROM ev WHERE wy BETWEEN 0 AND 0.9999) SELECT event_id, '14/' || x || '/' || y || '.pbf' AS plain, '14/' || lpad(CAST(x // 1000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(x % 1000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(y // 1000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(y % 1000 AS VARCHAR), 3, '0') || '.pbf' AS safe FROM tl")
def snk05(t: Tables):
    from terrane.sinks.archives import tile_path

    tiles = event_points(t).filter("wy between 0 and 0.9999").select("event_id", F.lit(14).alias("z"), geo.tile_column(F.col("wx"), F.lit(14)).alias("x"), geo.tile_column(F.col("wy"), F.lit(14)).alias("y"))
    return tiles.select("event_id", tile_path("{z}/{x}/{y}.pbf").alias("plain"), tile_path("{z}/{xs}/{ys}.pbf").alias("safe"))


@query("snk06_csv_rows", f"WITH {CONTENT} SELECT tile_id, to_base64(encode(content)) AS data64, lower(hex(encode(content))) AS data16 FROM content")
def snk06(t: Tables):
    from terrane.sinks.archives import encoded

    return tile_contents(t).select("tile_id", encoded(F.col("content").cast("binary"), "base64").alias("data64"), encoded(F.col("content").cast("binary"), "hex").alias("data16"))


@query("snk07_json_entries", f"WITH {CONTENT} SELECT '{{\"type\":\"tile\",\"tile_id\":' || tile_id || ',\"encodedData\":\"' || to_base64(encode(content)) || '\"}}' AS line FROM content UNION ALL SELECT '{{\"type\":\"initialization\"}}' UNION ALL SELECT '{{\"type\":\"finish\",\"metadata\":{{\"name\":\"sample\"}}}}'")
def snk07(t: Tables):
    from terrane.sinks.archives import json_entries

    return json_entries(tile_contents(t).select("tile_id", F.col("content").cast("binary").alias("data")), ["tile_id"], {"name": "sample"})
