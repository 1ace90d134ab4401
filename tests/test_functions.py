import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import geo, hashing, parse, tags, text, zooms
from terrane.operators import osm, stats, tiling
from terrane.operators.tiling import SortKey


def values(spark, texts, *columns):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string")
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


def test_numbers(spark):
    s = F.col("s")
    texts = ["123.123", "false", "1.5m", "-7", "1,234.5", "", None, "1e3", "9" * 25, "-.5"]
    got = values(spark, texts, parse.long_or_null(s).alias("a"), parse.double_or_null(s).alias("b"), parse.int_prefix(s).alias("c"), parse.rounded_int(s).alias("d"))
    assert [g[0] for g in got] == [123, None, 1, -7, 1234, None, None, 1, 2**63 - 1, 0]
    assert [g[1] for g in got] == [123.123, None, 1.5, -7.0, 1234.5, None, None, 1000.0, 1e25, -0.5]
    assert [g[2] for g in got][:5] == [123, None, 1, -7, 1] and [g[3] for g in got][:5] == [123, None, 2, -7, 1]


@pytest.mark.parametrize(
    "given,want",
    [("1", 1), ("1.5m", 1.5), ("1 km", 1000), ("1.5 mi", 2414.016), ("1 nmi", 1852), ("3'", 0.9144), ("15'3\"", 4.6482), ("328'11\"", 100.2538), ('6"', 0.1524), ("x", None), (None, None), ("5 furlongs", None)],
)
def test_lengths(spark, given, want):
    got = values(spark, [given], parse.metres(F.col("s")).alias("m"))[0][0]
    assert got == want or math.isclose(got, want, rel_tol=1e-6)


def test_flags_and_sizes(spark):
    s = F.col("s")
    got = values(spark, ["yes", "no", "", None, "-1", "0", "true"], parse.flag(s).alias("f"), parse.direction(s).alias("d"))
    assert got == [(True, 1), (False, 0), (False, 0), (False, 0), (True, -1), (False, 0), (True, 1)]
    assert [g[0] for g in values(spark, ["10g", "5m", "3K", "17", "x"], parse.memory_size(s).alias("b"))] == [10 << 30, 5 << 20, 3 << 10, 17, None]
    assert [g[0] for g in values(spark, ["1 kb/s", "8 Mbps", "2", "-1 b/s", "1 x"], parse.bandwidth(s).alias("b"))] == [1000, 1e6, 2, None, None]
    assert [r[0] for r in spark.createDataFrame([(1.0,), (1.5,)], "v double").select(parse.number_text(F.col("v")).alias("t")).collect()] == ["1", "1.5"]


def test_road_order(spark):
    df = spark.createDataFrame([({"highway": "motorway", "bridge": "yes", "layer": "1"},), ({"railway": "rail", "tunnel": "1"},), ({"layer": "99999"},), ({},)], "t map<string,string>")
    assert [r[0] for r in df.select(parse.road_order(F.col("t")).alias("z")).collect()] == [29, -3, 0, 0]


def test_texts(spark):
    s = F.col("s")
    got = values(spark, ["München (Munich)", "Москва (Moscow)", "東京", "", None], text.only_latin(s).alias("a"), text.without_latin(s).alias("b"))
    assert got == [(True, None), (False, "Москва"), (False, "東京"), (False, ""), (False, None)]
    assert [g[0] for g in values(spark, ["en", "zh-Hant", "EN", "", "en-", "sr-Latn-RS", None], text.language_tag(s).alias("t"))] == [True, True, False, False, False, True, False]
    assert [g[0] for g in values(spark, ["name:de", "name", "name:"], text.name_tag(s).alias("t"))] == [True, False, False]
    assert values(spark, ["abcb"], text.last_index_of(s, "b").alias("l"), text.index_of(s, "z").alias("i"), text.replace_first(s, "b", "-", 1).alias("r")) == [(3, -1, "a-cb")]
    assert [r[0] for r in spark.createDataFrame([(999,), (1500,), (2_000_000,)], "v bigint").select(text.storage(F.col("v")).alias("s")).collect()] == ["999", "1.5k", "2M"]
    assert hashing.plain_latin("Žleb Straße Улица") == "Zleb Strasse Ulica" and hashing.plain_latin(None) is None


def test_known_hashes(spark):
    assert hashing.fnv1a(b"") == -3750763034362895579 and hashing.fnv1a(b"a", hashing.FNV32) == 0xE40C292C - (1 << 32)
    assert [tuple(r) for r in spark.createDataFrame([("a",), (None,)], "s string").select(hashing.fnv1a64("s"), hashing.fnv1a32("s")).collect()][1] == (None, None)
    assert hashing.generated_ids("f", 0, range(2)).shape == (2,)


def test_tile_numbers(spark):
    df = spark.range(0, 4 + 16 + 64 + 1)
    back = geo.tile_from_id(F.col("id"))
    rows = df.select("id", back["z"].alias("z"), back["x"].alias("x"), back["y"].alias("y")).withColumn("again", geo.tile_id(F.col("z"), F.col("x"), F.col("y"))).collect()
    assert all(r["id"] == r["again"] for r in rows) and [(r["z"], r["x"], r["y"]) for r in rows[:3]] == [(0, 0, 0), (1, 0, 1), (1, 0, 0)]


def test_hilbert_is_a_curve(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    order = [(r["x"], r["y"]) for r in cells.withColumn("h", geo.hilbert_index(4, F.col("x"), F.col("y"))).orderBy("h").collect()]
    assert order[0] == (0, 0) and len(set(order)) == 256 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(order, order[1:]))
    assert [tuple(r) for r in spark.range(1).select(geo.hilbert_index(1, F.lit(0), F.lit(1)), geo.hilbert_index(1, F.lit(1), F.lit(1)), geo.hilbert_index(1, F.lit(1), F.lit(0))).collect()] == [(1, 2, 3)]


def test_mercator_and_zigzag(spark):
    df = spark.createDataFrame([(0.0, 0.0), (180.0, 85.0511), (-180.0, -89.0), (16.4, 48.2)], "lon double, lat double")
    rows = df.select("lon", "lat", geo.world_x(F.col("lon")).alias("x"), geo.world_y(F.col("lat")).alias("y")).collect()
    assert (rows[0]["x"], rows[0]["y"]) == (0.5, 0.5) and abs(rows[1]["y"]) < 1e-6 and rows[2]["y"] == 1.1
    packed = df.limit(1).select(geo.pack_location(F.lit(16.4), F.lit(48.2)).alias("p")).select(geo.unpack_x(F.col("p")).alias("x")).first()["x"]
    assert abs(packed - (16.4 + 180) / 360) < 1e-9
    v = spark.createDataFrame([(0,), (-1,), (1,), (-(2**31),), (2**31 - 1,)], "v int").select("v", geo.zigzag(F.col("v")).alias("c")).select("v", "c", geo.unzigzag(F.col("c")).alias("b")).collect()
    assert [r["c"] for r in v[:3]] == [0, 1, 2] and all(r["v"] == r["b"] for r in v)


def test_sort_keys(spark):
    df = spark.createDataFrame([(True, 3, 10.0), (False, 3, 10.0), (True, 5, 10.0), (True, 3, 20.0)], "b boolean, i int, d double")
    got = [r[0] for r in df.select(SortKey().trues_first(F.col("b")).ints(F.col("i"), 0, 10).doubles(F.col("d"), 0, 100, 10).get().alias("k")).collect()]
    assert got[0] < got[3] < got[2] < got[1] and got[0] == tiling.SORT_KEY_MIN + 31
    assert df.select(SortKey().logs(F.col("d"), 1, 100, 4).get().alias("k")).first()[0] == tiling.SORT_KEY_MIN + 2
    with pytest.raises(ValueError):
        SortKey().ints(F.col("i"), 0, 5000).ints(F.col("i"), 0, 5000)


def test_tags_and_zooms(spark):
    df = spark.createDataFrame([({"a": "1", "b": ""}, ["x", "y"])], "t map<string,string>, l array<string>")
    row = df.select(
        tags.has(F.col("t"), "a").alias("a"), tags.has(F.col("t"), "a", "2").alias("b"), tags.has_in_list(F.col("l"), "y", "z").alias("c"), tags.without_empty(F.col("t")).alias("d"),
        tags.merged(F.col("t"), F.create_map(F.lit("a"), F.lit("9"))).alias("e"), zooms.by_max_zoom(F.lit(5), {4: 1.0, 9: 2.0}).alias("f"), zooms.in_zooms(F.lit(5), 6, 9, F.lit(1)).alias("g"), zooms.from_zoom(F.lit(5), 5, F.lit(1)).alias("h"),
        zooms.translations([F.create_map(F.lit("name:en"), F.lit("")), F.create_map(F.lit("name:en"), F.lit("X"), F.lit("name:fr"), F.lit("Y"))], ["en"]).alias("i"),
    ).first()
    assert tuple(row) == (True, False, True, {"a": "1"}, {"a": "9", "b": ""}, 2.0, None, 1, {"name:en": "X"})


def test_point_tiles_wrap_and_clamp(spark):
    df = spark.createDataFrame([(1, 0.001, 0.001, 2)], "id int, wx double, wy double, z int")
    got = {(r["tx"], r["ty"]) for r in tiling.point_tiles(df, 4.0).collect()}
    assert got == {(3, 0), (0, 0)}
    assert tiling.tile_ranges(0.3, 0.3, 0.6, 0.6, range(2, 3)) == [(2, 1, 1, 3, 3)]
    boxes = spark.createDataFrame([(0.2, 0.2, 0.6, 0.3, 2)], "minx double, miny double, maxx double, maxy double, z int")
    assert tiling.box_tiles(boxes).count() == 6


def test_label_limit_keeps_rows_without_a_cell(spark):
    rows = [(k, 1 if k < 6 else None, k % 3) for k in range(9)]
    df = spark.createDataFrame(rows, "id int, cell int, rank int")
    kept = tiling.limit_per_cell(df, "cell", 2, [], [F.col("rank"), F.col("id")])
    assert sorted(r["id"] for r in kept.collect()) == [0, 3, 6, 7, 8] and tiling.limit_per_cell(df, "cell", 0, [], [F.col("id")]).count() == 9


def test_ways(spark):
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in range(1, 8)] + [(9, None, None)], "id bigint, lon double, lat double")
    ways = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 2, 99]), (3, [5, 9]), (4, [1, 2, 1]), (5, [7]), (6, [])], "way_id bigint, node_ids array<bigint>")
    lines = {r["way_id"]: [p["lon"] for p in r["line"]] for r in osm.way_lines(ways, nodes).collect()}
    assert lines == {1: [1, 2, 3], 4: [1, 2, 1], 5: [7]}
    assert osm.way_nodes(ways, nodes).count() == 7
    cut = {(r["way_id"], r["segment"]): r["node_ids"] for r in osm.split_at_shared_nodes(ways).collect()}
    assert cut == {(1, 0): [1, 2], (1, 1): [2, 3], (2, 0): [3, 2], (2, 1): [2, 99], (3, 0): [5, 9], (4, 0): [1, 2], (4, 1): [2, 1]}
    versions = spark.createDataFrame([(1, 1, True, 5.0), (1, 2, False, 6.0), (2, 1, None, 7.0), (None, 1, True, 8.0)], "id bigint, version int, visible boolean, lat double")
    assert [tuple(r) for r in osm.current(versions, ["lat"]).collect()] == [(2, 7.0)]


def test_archive_statistics(spark):
    tiles = spark.createDataFrame([(k, "ab"[k % 2] * (k % 2 + 1)) for k in range(10)], "tile_id bigint, content string")
    d = stats.deduplicated(tiles)
    assert {(r["first_tile"], r["copies"]) for r in d.collect()} == {(0, 5), (1, 5)}
    got = sorted((r["first_tile"], r["offset"]) for r in stats.offsets(d.select("first_tile", "length").distinct(), 3).collect())
    assert got == [(0, 0), (1, 1)]
    runs = tiling.runs(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "id bigint, c string"), "id", ["c"])
    assert sorted(tuple(r) for r in runs.collect()) == [("a", 1, 2), ("a", 4, 1), ("b", 3, 1)]
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, c string"), spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, c string")
    assert sorted(tuple(r) for r in stats.compare(a, b, ["k"], "c").collect()) == [(1, "missing_right"), (2, "different"), (4, "missing_left")]
    cells = spark.createDataFrame([(1, 0, "a", 10), (2, 1, "a", 30)], "tile_id bigint, z int, layer string, size int")
    total = stats.summary(cells, spark.createDataFrame([(1, 3)], "tile_id bigint, loads int")).filter("level = 3").first()
    assert (total["max_size"], total["mean_size"], total["weighted_size"]) == (30, 20, 10)
    assert stats.summary(cells, None).filter("level = 3").first()["weighted_size"] == 20
