import __spark_entry__ as entry
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.plans.points import current_nodes, current_relations
from terrane.plans.registry import Tables

DATA = "/root/testdata/sf0.01"


def test_labels_to_zoom_14(spark):
    """Every zoom is made, and beyond the zoom of the limit every tagged node is on a tile."""
    got = entry.queries()["qry01_points_with_label_limit"](spark, DATA).select("id", "z").distinct().collect()
    by_zoom = {}
    for r in got:
        by_zoom.setdefault(r["z"], set()).add(r["id"])
    nodes = current_nodes(Tables(spark, DATA)).filter("size(tags) > 0 and lon between -180 and 180 and lat between -85 and 85")
    want = {r[0] for r in nodes.select(geo.feature_id(F.col("id"), F.lit("node"))).collect()}
    assert sorted(by_zoom) == list(range(15))
    assert want and want <= by_zoom[13] and want <= by_zoom[14]


def test_named_areas_of_relations_reach_the_handler(spark):
    made = {r["id"] for r in entry.queries()["udf01_python_handler"](spark, DATA).collect()}
    named = current_relations(Tables(spark, DATA)).filter("tags['name'] <> ''").select(geo.feature_id(F.col("id"), F.lit("relation")))
    assert made & {r[0] for r in named.collect()}


def test_compressed_tiles_have_the_buildings(spark):
    """Tiles that hold buildings only; a building smaller than the grid of its tile leaves no tile."""
    made = {(r["z"], r["x"], r["y"]) for r in entry.queries()["snk15_compressed_tiles"](spark, DATA).collect()}
    layers = {}
    for r in entry.queries()["til03_sliced_tiles"](spark, DATA).select("layer", "z", "x", "y").collect():
        layers.setdefault((r["z"], r["x"], r["y"]), set()).add(r["layer"])
    assert {z for z, _, _ in made} == {4, 5, 6, 7, 8} and made <= set(layers)
    assert any(layers[tile] == {"building"} for tile in made)


def test_tile_hook_keeps_every_feature(spark):
    """As many features as the layer hook leaves, which sees the same build."""
    hooked = entry.queries()["udf06_tile_hook"](spark, DATA).collect()
    totals = {r["z"]: r["n"] for r in entry.queries()["udf05_layer_hook"](spark, DATA).groupBy("z").agg(F.sum("n").alias("n")).collect()}
    assert {z: sum(r["n"] for r in hooked if r["z"] == z) for z in totals} == totals
    assert max(r["n"] for r in hooked) > 20 and all(r["last"] == r["n"] - 1 for r in hooked)
