import importlib.util
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_and_sql():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and len(names) > 200
    core = {"p1_found", "p2_found", "p3_found", "p5_found"}
    assert core <= names
    text = {"p4_found", "p6_containers", "p7_mixture", "p8_found"}
    present = importlib.util.find_spec("terrane.llm") is not None and importlib.util.find_spec("terrane.llm.queries") is not None
    assert text <= names if present else not text & names


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_found", "flagship_point_labels", "join06_split_ways", "exp01_schema_features", "agg09_summary_sets", "flt11_all_matches"])
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    sql = entry.oracle_sql()[name]
    for table in set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", sql)):
        try:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        except duckdb.Error:
            continue  # a name of the query's own
    cursor = db.execute(sql)
    columns = [c[0] for c in cursor.description]
    show = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(show, row)) for row in cursor.fetchall())
    assert sorted(tuple(map(show, row)) for row in entry.queries()[name](spark, SF).select(*columns).collect()) == want
