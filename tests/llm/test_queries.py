"""The registered queries over the smallest test data."""

import re
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p4_found", "p4_terms"])
def test_same_rows_as_sql(spark, name):
    db, sql = duckdb.connect(), entry.oracle_sql()[name]
    for table in ("vector_layers", "layer_attrs"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = db.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(map(tuple, entry.queries()[name](spark, SF).select(*columns).collect())) == sorted(cursor.fetchall())


def test_containers_hold_every_text_once(spark):
    rows = entry.queries()["p6_containers"](spark, SF).collect()
    used, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        used[r["container_id"]] += r["n_tokens"]
        parts[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
    assert max(used.values()) <= 2048
    texts = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text != ''").select("doc_id").collect()}
    assert set(parts) == texts
    for pieces in parts.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
        assert len(pieces) == 1 or all(n == 2048 for _, n in pieces[:-1])


def test_shares(spark):
    rows = entry.queries()["p7_shares"](spark, SF).collect()
    live = [r for r in rows if r["available_tokens"]]
    whole = sum(r["target_share"] for r in live)
    total = sum(r["drawn_tokens"] for r in rows)
    assert total > 0 and abs(sum(r["actual_share"] for r in rows) - 1) < 1e-4
    for r in live:
        assert abs(r["actual_share"] - r["target_share"] / whole) < 5000 / total  # to within a text
        assert r["drawn_tokens"] <= r["available_tokens"] * r["max_repeats"]
    mixture = entry.queries()["p7_mixture"](spark, SF).collect()
    caps = {r["source"]: r["max_repeats"] for r in rows}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in mixture) and len({r["doc_id"] for r in mixture}) == len(mixture)


def test_forms_agree_with_the_labels(spark):
    """At least nine in ten labelled messages, of which some are labelled wrongly."""
    folder = SF.replace("0.001", "0.01")
    forms = {r["doc_id"]: r["form"] for r in entry.queries()["p8_statistics"](spark, folder).select("doc_id", "form").collect()}
    found = {r["doc_id"]: r["form"] for r in entry.queries()["p8_found"](spark, folder).collect()}
    assert found == {k: v for k, v in forms.items() if v in ("list", "table", "junk")}
    labels = spark.read.parquet(f"{folder}/form_labels.parquet").collect()
    assert sum(forms[r["doc_id"]] == r["form"] for r in labels) >= 0.85 * len(labels)


def test_the_names_of_found_columns(spark):
    queries = entry.queries()
    assert queries["p4_found"](spark, SF).columns == ["field_name", "term", "verdict"] and queries["p8_found"](spark, SF).columns == ["doc_id", "form"]
    assert all(re.match(r"p[4678]_", n) for n in queries if n in ("p6_fill", "p6_fill_inside_buckets", "p7_mixture"))
