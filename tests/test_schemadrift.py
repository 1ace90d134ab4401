import datetime as dt
import json

from terrane.operators import schemadrift as sd

FILES = "file_id bigint, dataset string, published_at timestamp, loaded_at timestamp, version string, primary_column string, encoding string, geometry_types array<string>, field string"
ROWS = "row_id bigint, file_id bigint, feature_id bigint, record string, lost string"
D = [dt.datetime(2024, 1, d) for d in range(1, 20)]


def file(k, day, version="1", encoding="WKB", kinds=("Point",), dataset="a"):
    return (k, dataset, None if day is None else D[day], D[day or 0], version, "geometry", encoding, None if kinds is None else list(kinds), "clash")


def tables(spark, files, records):
    rows, n = [], 0
    for k, items in records.items():
        for feature, item in enumerate(items):
            n += 1
            rows.append((n, k, feature, item if item is None or isinstance(item, str) else json.dumps(item), "clash"))
    rows += rows[:2]  # delivered twice
    return spark.createDataFrame(files + files[:1], FILES), spark.createDataFrame(rows, ROWS)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_types_and_texts():
    o = sd.read_record('{"a": 1, "b": 1.0, "c": 1e2, "d": "1", "e": true, "f": [1], "g": {"x": 1, "a": null}, "h": null, "i": NaN}')
    assert {k: sd.type_of(v) for k, v in o.items() if v is not None} == {"a": "integer", "b": "decimal", "c": "decimal", "d": "string", "e": "boolean", "f": "list", "g": "object", "i": "decimal"}
    assert sd.text_of(o["b"]) == "1.0" and sd.text_of(o["d"]) == sd.text_of(o["a"]) == "1" and sd.text_of(o["g"]) == '{"a":null,"x":1}' and sd.text_of(o["g"], False) == '{"x":1,"a":null}'
    assert sd.read_record(None) == sd.read_record("") == sd.read_record("[1]") == sd.read_record('{"a":') == sd.read_record("[" * 100_000) == {}
    assert sorted(sd.alternatives({"x": [sd._Whole("1"), {"y": "z"}]}, "p")) == [("p", "object"), ("p.x", "list"), ("p.x[]", "integer"), ("p.x[]", "object"), ("p.x[].y", "string")]


def test_all_kinds_of_change(spark):
    files = [file(2, 5, version="2", encoding="wkb", kinds=("Point", "Point")), file(1, 1), file(3, 7, version="2", kinds=None), file(9, 2, dataset="b")]
    old = [{"id": k, "height": k + 0.5, "name": f"n{k}", "pop": k * 10, "gone": "x", "flag": True} for k in range(10)]
    new = [{"id": k, "tall": k + 0.5, "name": k, "people": str(k * 10) if k else "odd", "extra": [1], "flag": None if k else True} for k in range(10)]
    records = {1: old, 2: new, 3: [*new, "", None, "{"], 9: [{"z": 1}]}
    got = found(sd.all_changes(*tables(spark, files, records)))
    assert got == sorted(
        [
            (2, "renamed", "tall", "height"), (2, "renamed", "people", "pop"), (2, "retyped", "people", ""), (2, "retyped", "name", ""), (2, "added", "extra", ""), (2, "removed", "gone", ""), (2, "version", "geometry", ""),
            (3, "geometry_types", "geometry", ""),
        ]
    )


def test_one_renaming_each_and_the_best_wins(spark):
    old = [{"a": f"v{k}", "b": f"v{k}" if k < 7 else "o"} for k in range(10)]
    new = [{"x": f"v{k}", "y": f"v{k}" if k < 8 else "p"} for k in range(10)]
    got = found(sd.field_changes(*tables(spark, [file(1, 1), file(2, 2)], {1: old, 2: new})))
    assert got == [(2, "renamed", "x", "a"), (2, "renamed", "y", "b")]
    little = [{"x": "v0" if k else "q"} for k in range(10)]
    got = found(sd.field_changes(*tables(spark, [file(1, 1), file(2, 2)], {1: [{"a": f"w{k}"} for k in range(10)], 2: little})))
    assert got == [(2, "added", "x", ""), (2, "removed", "a", "")]


def test_sixty_percent_is_enough(spark):
    old = [{"a": f"v{k}"} for k in range(10)]
    new = [{"x": f"v{k}" if k < 6 else "?"} for k in range(10)]
    assert found(sd.field_changes(*tables(spark, [file(1, 1), file(2, 2)], {1: old, 2: new}))) == [(2, "renamed", "x", "a")]


def test_consistent_table_follows_renamings(spark):
    files = [file(1, 1), file(2, 2), file(3, 3)]
    records = {1: [{"h": k} for k in range(4)], 2: [{"height": k} for k in range(4)], 3: [{"height": k + 0.5} for k in range(3)] + [{"height": {"raw": 1}}]}
    rows = sd.consistent_table(*tables(spark, files, records)).collect()
    assert {(r["file_id"], r["field_name"], r["source_field"]) for r in rows} == {(1, "h", "h"), (2, "h", "height"), (3, "h", "height")}
    assert {r["canonical_type"] for r in rows} == {"string"} and len(rows) == 12
    assert [r["v_json"] for r in rows if r["type_tag"] == "object"] == ['{"raw":1}']
    assert sorted(r["v_decimal"] for r in rows if r["v_decimal"] is not None) == [0.5, 1.5, 2.5]
    news = {(r["path"], r["type"]): r["file_id"] for r in sd.appearing_alternatives(*tables(spark, files, records)).collect()}
    assert news == {("h", "integer"): 1, ("height", "integer"): 2, ("height", "decimal"): 3, ("height", "object"): 3, ("height.raw", "integer"): 3}


def test_empty_tables_and_files_without_rows(spark):
    files, rows = spark.createDataFrame([], FILES), spark.createDataFrame([], ROWS)
    assert sd.all_changes(files, rows).count() == 0
    assert sd.consistent_table(files, rows).count() == 0
    some, _ = tables(spark, [file(1, None), file(2, 2)], {1: [{"a": 1}]})
    only_first = spark.createDataFrame([(1, 1, 1, '{"a": 1}', "")], ROWS)
    assert found(sd.field_changes(some, only_first)) == [(2, "removed", "a", "")]


def test_numbers_have_one_exact_spelling():
    same = {"5": ["5", "5.0", "5e0", "0.5E1", "5.000"], "0": ["0", "-0", "0.000", "-0.0e5"], "-0.0125": ["-0.0125", "-1.25e-2"], "99999999999999999999": ["99999999999999999999", "9.9999999999999999999e19"], "0.1000000000000000000001": ["0.1000000000000000000001"]}
    for want, spellings in same.items():
        assert {sd.exact_number(x) for x in spellings} == {want}
    assert sd.exact_number("1e1000000") == "1E1000000" and sd.exact_number("-2.50e-100000") == "-25E-100001"
    assert sd.exact_number("NaN") is None and sd.exact_number("-Infinity") is None and sd.exact_number("x") is None


def test_canonical_values_and_big_integers(spark):
    records = {1: [{"n": 5}], 2: ['{"n": 5.0}', '{"n": 99999999999999999999}', '{"n": NaN}'], 3: [{"o": {"b": 1.50, "a": [True, None]}}]}
    rows = sd.consistent_table(*tables(spark, [file(1, 1), file(2, 2), file(3, 3, dataset="b")], records)).collect()
    n = {(r["file_id"], r["feature_id"]): r for r in rows}
    assert n[1, 0]["canonical"] == n[2, 0]["canonical"] == "5" and n[1, 0]["canonical_type"] == "decimal"
    assert (n[1, 0]["conversion"], n[2, 0]["conversion"], n[2, 2]["conversion"], n[2, 2]["canonical"]) == ("converted", "kept", "failed", None)
    assert n[2, 1]["v_integer"] is None and n[2, 1]["v_big_integer"] == n[2, 1]["canonical"] == "9" * 20
    assert n[3, 0]["canonical"] == '{"a":[true,null],"b":1.5}' and n[3, 0]["v_json"] == '{"b":1.5,"a":[true,null]}'


def test_rows_without_a_known_file_stay(spark):
    files = spark.createDataFrame([file(1, 1), (2, None, D[1], D[1], "1", "g", "WKB", [], "")], FILES)
    rows = spark.createDataFrame([(1, 1, 7, '{"a": 1}', ""), (2, 2, None, '{"a": 1}', ""), (3, 3, 7, '{"a": 1}', ""), (4, None, 7, '{"a": 1}', ""), (None, 1, 8, '{"a": 2}', ""), (None, 1, 8, '{"a": 2}', "")], ROWS)
    got = sorted(((r["dataset"] or "", r["file_id"] or 0, r["feature_id"] or 0, r["field_name"], r["canonical"]) for r in sd.consistent_table(files, rows).collect()))
    assert got == [("", 0, 7, "a", "1"), ("", 2, 0, "a", "1"), ("", 3, 7, "a", "1"), ("a", 1, 7, "a", "1"), ("a", 1, 8, "a", "2"), ("a", 1, 8, "a", "2")]
