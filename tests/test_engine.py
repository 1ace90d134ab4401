import json

import pytest
from pyspark.sql import functions as F

from terrane.engine import Engine, Handler, Profile
from terrane.operators.render import RenderOptions, decode_tiles
from terrane.rules import cel
from terrane.rules.ast import FALSE, TRUE, And, FieldIs, GeometryIs, Not, Or, TagIn, TagPresent, match_all, relevant, wildcard_regex
from terrane.rules.schema import SchemaError, SchemaPlan
from terrane.rules.specs import run
from terrane.sources.files import mbtiles
from terrane.streams import sorted_groups

INPUT = "id bigint, source_layer string, tags map<string,string>, geom_type string, shape array<array<array<double>>>"


def inputs(spark):
    rows = [(k, "", {"amenity": "cafe" if k % 2 else "pub", "name": f"n{k}"}, "point", [[[k * 10.0 - 100, k * 5.0 - 40]]]) for k in range(1, 15)]
    rows += [(100, "", {"highway": "path"}, "line", [[[0.0, 0.0], [30.0, 10.0]]]), (101, "", None, "point", [[[0.0, 0.0]]]), (102, "", {"amenity": "cafe"}, "point", None)]
    return spark.createDataFrame(rows, INPUT)


def test_simplify():
    a, b = TagPresent("a"), TagIn("b", ("x",))
    assert And((a, TRUE, And((b, a)))).simplified() == And((a, b))
    assert Or((a, FALSE)).simplified() == a and Or((a, TRUE)).simplified() == TRUE and And((a, FALSE)).simplified() == FALSE
    assert Not(Or((a, b))).simplified() == And((Not(a), Not(b))) and Not(Not(a)).simplified() == a
    assert Not(TagIn("k", ("",))).simplified() == TagPresent("k") and TagIn("k", ("%",)).simplified() == TagPresent("k")
    assert (a & b) == And((a, b)) and (a | b) == Or((a, b)) and ~a == Not(a)
    rules = [("x", And((FieldIs("source", ("osm",)), a))), ("y", GeometryIs("line"))]
    assert [n for n, _ in relevant(rules, {"source": "sea"})] == ["y"] and relevant(rules, {"source": "sea", "geometry": "point"}) == []
    assert wildcard_regex("a.%\\%") == "^a\\..*%$"


def test_match_keys(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"b": "2"}), (3, None), (4, {"a": ""})], "id bigint, tags map<string,string>")
    rules = [("both", And((TagPresent("a"), TagPresent("b")))), ("any", Or((TagPresent("a"), TagPresent("b")))), ("none", Not(TagPresent("a")))]
    got = {(r["id"], r["rule"]): r["match_keys"] for r in match_all(df, rules).collect()}
    assert got == {(1, "both"): ["a", "b"], (1, "any"): ["a"], (2, "any"): ["b"], (2, "none"): [], (3, "none"): [], (4, "none"): []}


@pytest.mark.parametrize(
    "script,want",
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ('"a" + "b"', "ab"), ('"abc".substring(1, 2)', "b"), ('"abc".substring(1)', "bc"), ('"a;b".split(";").size()', 2), ("[1, 5, 2].exists(x, x > 4)", True), ("[1, 5, 2].all(x, x > 4)", False),
        ("max([1, 5, 2])", 5), ('tags["k"] == "v" ? "yes" : "no"', "yes"), ('tags["none"] == "v"', False), ('tags.has("k", "v", "w")', True), ('tags.getOrDefault("z", "d")', "d"), ('"Ab".lowerAscii().indexOf("b")', 1),
        ('"abcabc".lastIndexOf("b")', 4), ('"aXbX".replace("X", "-", 1)', "a-bX"), ('"a1b2".replaceRegex("[0-9]", "")', "ab"), ('int("12") + 1', 13), ('double("x")', None), ("!(1 < 2) || 2 >= 2", True), ('"b" in ["a", "b"]', True), ("args.n * 2", 8),
        ('["a", "b"].join("-")', "a-b"), ('coalesce(tags["x"], "y")', "y"), ('nullif("a", "a")', None), ('"x".matches("^[a-z]$")', True), ("-3 + 1", -2), ('size("abc")', 3), ('[1, 2, 3].filter(x, x != 2).size()', 2), ("7 % 4", 3), ('"a\\"b"', 'a"b'),
    ],
)
def test_scripts(spark, script, want):
    df = spark.createDataFrame([({"k": "v"},)], "tags map<string,string>")
    assert df.select(cel.compile_script(script, {"tags": F.col("tags"), "args.n": 4}).alias("x")).first()["x"] == want


@pytest.mark.parametrize("script", ["1 +", "foo", "foo(1)", '"a".nope()', "1 ~ 2", "[1, 2", "(1"])
def test_bad_scripts_fail_when_compiled(script):
    with pytest.raises(cel.ScriptError):
        cel.compile_script(script, {})


SCHEMA = """
schema_name: Test
args: {limit: 12}
layers:
- id: food
  features:
  - source: osm
    geometry: point
    min_zoom: ${ args.limit }
    include_when: {amenity: [cafe, 'pub%']}
    exclude_when: {name: n3}
    attributes:
    - {key: kind, type: match_value}
    - {key: by, type: match_key}
    - {key: name, min_zoom: 13}
    - {key: fixed, value: 7}
    - {key: size, value: {match: [{if: {amenity: cafe}, value: small}, {else: large}]}}
    - {key: never, include_when: {amenity: none}, else: fallback}
"""


def test_schema_specs(spark):
    plan = SchemaPlan.load(SCHEMA)
    assert plan.used_sources() == {"osm"} and plan.layers == ["food"]
    examples = [
        {"name": "cafe", "input": {"geometry": "point", "tags": {"amenity": "cafe", "name": "x"}}, "output": {"layer": "food", "geometry": "point", "min_zoom": 12, "tags": {"kind": "cafe", "by": "amenity", "name": "x", "fixed": 7, "size": "small", "never": "fallback"}, "allow_extra_tags": False}},
        {"name": "pubs", "input": {"geometry": "point", "tags": {"amenity": "pubs"}}, "output": [{"layer": "food", "tags": {"size": "large", "name": None}}]},
        {"name": "excluded", "input": {"geometry": "point", "tags": {"amenity": "cafe", "name": "n3"}}, "output": []},
        {"name": "line", "input": {"geometry": "line", "tags": {"amenity": "cafe"}}},
        {"name": "wrong", "input": {"geometry": "point", "tags": {"amenity": "cafe"}}, "output": {"layer": "food", "tags": {"size": "huge"}}},
    ]
    outcomes = {o.name: o for o in run(spark, plan, examples)}
    assert [n for n, o in outcomes.items() if not o.passed] == ["wrong"], outcomes
    with pytest.raises(SchemaError):
        SchemaPlan({"layers": [{"id": "a", "features": [{"geometry": "cube"}]}]}).features(spark.createDataFrame([], "id bigint"))


def test_whole_build(spark, tmp_path):
    def handle(feature):
        if feature["id"] == 5:
            raise RuntimeError("one bad feature")
        yield {"layer": "python", "maxzoom": 1, "attrs": {"n": feature["tags"]["name"]}}

    def shout(group):
        return group.assign(attrs=[dict(a) | {"seen": "yes"} for a in group["attrs"]])

    def broken(group):
        raise RuntimeError("leaves the features alone")

    profile = Profile(
        "test",
        [Handler(TagIn("amenity", ("cafe",)), {"layer": "cafe", "maxzoom": 2}, layers=("cafe",)), Handler(TagPresent("name"), function=handle, layers=("python",)), Handler(GeometryIs("line"), {"layer": "road", "maxzoom": 2}, layers=("road",)), Handler(FieldIs("source", ("other",)), {"layer": "x"})],
        RenderOptions(render_maxzoom=2), post_process_layer={"cafe": shout, "road": broken}, finish=lambda source, spark: None,
    )
    engine = Engine(spark, profile).add_features("osm", inputs(spark))
    path = str(tmp_path / "map.mbtiles")
    engine.write(path)
    back = decode_tiles(mbtiles(spark, path)).filter("z = 0").collect()
    by = {}
    for r in back:
        by.setdefault(r["layer"], []).append(r)
    assert {r["id"] for r in by["cafe"]} == {1, 3, 5, 7, 9, 11, 13} and all(r["attrs"]["seen"] == "yes" for r in by["cafe"])
    assert {r["id"] for r in by["python"]} == set(range(1, 15)) - {5} and len(by["road"]) == 1
    only = Profile("test", profile.handlers[:3], profile.options, only_layers=["road"])
    assert {r["layer"] for r in Engine(spark, only).add_features("osm", inputs(spark)).features().select("layer").distinct().collect()} == {"road"}
    assert not Profile("t", [Handler(FieldIs("source", ("other",)))]).cares_about("osm")
    assert Engine(spark, Profile("t", [Handler(FieldIs("source", ("other",)))])).add_features("osm", inputs(spark)).tiles().count() == 0
    assert engine.metadata()["name"] == "test" and json.dumps(engine.metadata())


def test_osm_source_and_tile_hook(spark):
    nodes = spark.createDataFrame([(1, 10.0, 10.0, {"name": "a"}), (2, 20.0, 20.0, {}), (3, 10.0, 20.0, {}), (4, None, None, {"name": "lost"})], "id bigint, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame([(7, [1, 2, 3, 1], {"building": "yes"}), (8, [1, 2], {"highway": "path"}), (9, [1, 99], {"highway": "path"})], "way_id bigint, node_ids array<bigint>, tags map<string,string>")
    profile = Profile("o", [Handler(TRUE, {"maxzoom": 0})], RenderOptions(render_maxzoom=0), post_process_tile=lambda group: group[group["kind"] != "point"])
    got = Engine(spark, profile).add_osm("osm", nodes, ways).rendered().select("id", "kind").distinct().collect()
    assert {tuple(r) for r in got} == {(72, "polygon"), (82, "line")}


def test_areas_of_relations(spark):
    nodes = spark.createDataFrame([(k, y, x, {}) for k, (x, y) in enumerate([(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0), (10.0, 10.0), (20.0, 10.0), (20.0, 20.0)], 1)], "id bigint, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame([(1, [1, 2, 3], {}), (2, [1, 4, 3], {}), (3, [5, 6, 7, 5], {"natural": "water"})], "way_id bigint, node_ids array<bigint>, tags map<string,string>")
    relations = spark.createDataFrame([(9, {"type": "multipolygon", "landuse": "forest"}), (8, {"type": "route"})], "id bigint, tags map<string,string>")
    members = spark.createDataFrame([(9, "way", w, k, r) for k, (w, r) in enumerate([(1, "outer"), (2, "wrong"), (3, None), (3, None), (77, "outer")])] + [(8, "way", 1, 0, "")], "relation_id bigint, member_type string, member_ref bigint, member_pos int, role string")
    profile = Profile("a", [Handler(TagPresent("landuse"), {"layer": "land", "maxzoom": 0})], RenderOptions(render_maxzoom=0))
    rows = Engine(spark, profile).add_osm("osm", nodes, ways, relations, members).rendered().collect()
    assert [(r["id"], r["kind"], len(r["ends"])) for r in rows] == [(93, "polygon", 2)]


MODES = """
layers:
- id: label
  buffer: 0
  features:
  - {geometry: polygon_centroid, min_zoom: 3, max_zoom: 5, include_when: {building: __any__}, attributes: [{key: name, min_zoom: 4}, {key: area, value: '${ int(feature.area()) }'}]}
  - {geometry: line_midpoint, min_zoom: 3, max_zoom: 3, include_when: {highway: path}, attributes: [{key: metres, value: '${ int(feature.length()) }'}]}
- id: piece
  features:
  - {geometry: split_line, min_zoom: 0, max_zoom: 0, include_when: {highway: __any__}}
- id: small
  features:
  - {geometry: polygon, min_zoom: 0, max_zoom: 0, min_size_at_max_zoom: 200, include_when: {building: __any__}}
"""


def small_map(spark):
    places = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (20.0, 0.0), (10.0, -10.0)]
    nodes = spark.createDataFrame([(k, y, x, {}) for k, (x, y) in enumerate(places, 1)], "id bigint, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame(
        [(7, [1, 2, 3, 4, 1], {"building": "yes", "name": "hall"}), (8, [1, 2, 5], {"highway": "path"}), (9, [2, 6], {"highway": "road"})], "way_id bigint, node_ids array<bigint>, tags map<string,string>"
    )
    return nodes, ways


def test_build_obeys_the_schema(spark):
    """Geometry modes, gated attributes, sizes, measures and split lines; rules that name no source read every source."""
    profile = Profile.of(SchemaPlan.load(MODES), options=RenderOptions(render_maxzoom=5))
    assert profile.cares_about("anything") and profile.derives
    engine = Engine(spark, profile).add_osm("osm", *small_map(spark))
    rows = engine.rendered().collect()
    halls = {r["z"]: r for r in rows if r["layer"] == "label" and r["id"] == 72}
    assert set(halls) == {3, 4, 5} and all(r["kind"] == "point" and len(r["xy"]) == 2 for r in halls.values())
    assert "name" not in halls[3]["attrs"] and halls[4]["attrs"]["name"] == "hall"
    assert abs(int(halls[3]["attrs"]["area"]) / 1.2308e12 - 1) < 0.01
    path, *_ = [r for r in rows if r["layer"] == "label" and r["id"] == 82]
    assert path["kind"] == "point" and abs(int(path["attrs"]["metres"]) - 2223901) < 3000
    assert sorted({(r["id"], len(r["xy"]) // 2) for r in rows if r["layer"] == "piece"}) == [(82, 2), (92, 2), (182, 2)]  # way 8 meets others at node 2
    assert engine.failures == dict.fromkeys(("handler", "shape", "hook", "merge", "area"), 0)


def test_least_sizes_and_buffers_of_a_schema(spark):
    text = """
layers:
- id: a
  buffer: 64
  features: [{geometry: polygon, min_zoom: 0, max_zoom: 0, min_size_at_max_zoom: 200}, {geometry: line, min_zoom: 1, max_zoom: 1, include_when: {highway: road}}]
- id: b
  features: [{geometry: line, min_zoom: 1, max_zoom: 1, include_when: {highway: road}}]
"""
    profile = Profile.of(SchemaPlan.load(text), options=RenderOptions(render_maxzoom=0))
    rows = Engine(spark, profile).add_osm("osm", *small_map(spark)).rendered().collect()
    assert not [r for r in rows if r["kind"] == "polygon"]
    tiles = {layer: {(r["x"], r["y"]) for r in rows if r["layer"] == layer} for layer in "ab"}
    assert tiles["b"] < tiles["a"] and len(tiles["a"]) == 4


def test_members_know_their_relations(spark):
    relations = spark.createDataFrame([(1, {"type": "route", "ref": "A"}), (2, {"type": "route", "ref": "B"}), (3, {"type": "site"})], "id bigint, tags map<string,string>")
    members = spark.createDataFrame([(2, "way", 8, 0, None), (1, "way", 8, 0, "main"), (1, "way", 8, 3, "main"), (3, "way", 8, 0, ""), (1, "node", 8, 0, "")], "relation_id bigint, member_type string, member_ref bigint, member_pos int, role string")

    def handle(feature):
        if feature["relations"] is not None and len(feature["relations"]):
            yield {"layer": "route", "attrs": {"refs": ",".join(dict(x["tags"])["ref"] + ":" + x["role"] for x in feature["relations"])}}

    seen = []
    profile = Profile("r", [Handler(TagPresent("highway"), function=handle)], member_relations=TagIn("type", ("route",)), preprocess={"ways": lambda df: seen.append(1) or df.filter("way_id != 9")})
    rows = Engine(spark, profile).add_osm("osm", *small_map(spark), relations, members).features().collect()
    assert [(r["id"], r["attrs"]) for r in rows] == [(82, {"refs": "A:main,B:"})] and seen


def test_stretches_of_a_line(spark):
    """Attributes of parts of a line, later ones over earlier ones, equal neighbours joined."""
    import numpy as np

    from terrane.operators.render import _stretched

    line = np.array([[0.0, 0.0], [1.0, 0.0]])
    stretches = [{"start_at": 0.2, "end_at": 0.6, "attrs": {"a": "1"}}, {"start_at": 0.5, "end_at": 0.8, "attrs": {"a": "2", "b": "x"}}, {"start_at": 0.8, "end_at": 1.2, "attrs": {"a": "2", "b": "x"}}]
    got = [(p[:, 0].round(9).tolist(), own) for p, own in _stretched(line, stretches, {"k": "v"})]
    assert got == [([0.0, 0.2], {"k": "v"}), ([0.2, 0.5], {"k": "v", "a": "1"}), ([0.5, 1.0], {"k": "v", "a": "2", "b": "x"})]
    struct = F.array(*[F.struct(F.lit(s["start_at"]).alias("start_at"), F.lit(s["end_at"]).alias("end_at"), F.create_map(*[F.lit(x) for p in s["attrs"].items() for x in p]).alias("attrs")) for s in stretches])
    profile = Profile("s", [Handler(TagIn("highway", ("path",)), {"layer": "l", "maxzoom": 0, "stretches": struct})], RenderOptions(render_maxzoom=0, min_size_at_max=0.0))
    rows = Engine(spark, profile).add_osm("osm", *small_map(spark)).rendered().collect()
    assert sorted(r["attrs"].get("a", "") for r in rows) == ["", "1", "2"]


def test_failures_are_counted(spark):
    def bad(_):
        raise RuntimeError("no")

    profile = Profile("f", [Handler(TRUE, function=bad), Handler(TRUE, {"layer": "x", "maxzoom": 0})], RenderOptions(render_maxzoom=0), post_process_layer={"x": bad})
    engine = Engine(spark, profile).add_features("osm", inputs(spark))
    assert engine.rendered().count() > 0
    assert engine.failures["handler"] == 17 and engine.failures["hook"] >= 1


def test_kernel_runs_once_in_a_build(spark):
    """One cutting stage, whatever limits, hooks and merges follow."""
    profile = Profile("o", [Handler(TRUE, {"layer": "a"}), Handler(TRUE, {"layer": "b"})], RenderOptions(render_maxzoom=3, grid_px=32.0, grid_limit=2), merge={"a": {"min_length": 0.0}}, post_process_layer={"a": lambda g: g, "b": lambda g: g})
    plan = Engine(spark, profile).add_features("osm", inputs(spark)).rendered()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas cut(") == 1


def test_partial_evaluation_keeps_what_may_still_hold():
    assert GeometryIs("any").partial({"geometry": "line"}) == TRUE
    assert GeometryIs("polygon").partial({"geometry": "line"}) == GeometryIs("polygon") and GeometryIs("line").partial({"geometry": "polygon"}) == GeometryIs("line")
    assert GeometryIs("point").partial({"geometry": "line"}) == FALSE and GeometryIs("line").partial({"geometry": "line"}) == TRUE
    assert SchemaPlan.load("layers: [{id: a, features: [{geometry: line}]}]").uses("x") and not SchemaPlan.load("layers: [{id: a, features: [{source: y, geometry: line}]}]").uses("x")


def test_sorted_groups_over_batches():
    import pandas as pd

    frames = [pd.DataFrame({"k": [1, 1, 2], "v": [1, 2, 3]}), pd.DataFrame({"k": [], "v": []}), pd.DataFrame({"k": [2, 3], "v": [4, 5]})]
    assert [g["v"].tolist() for g in sorted_groups(frames, ["k"])] == [[1, 2], [3, 4], [5]]
