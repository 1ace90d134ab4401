import duckdb
import pytest

import __spark_entry__ as entry

PLACE = "(event_id * 7919) % 360000 BETWEEN 180000 AND 205000 AND (event_id * 104729) % 170000 BETWEEN 60000 AND 85000"
#: Query, its sibling over a part, and what makes that part in the sibling's SQL.
WHOLE = [
    ("join12_proximity_pairs_all_events", "join12_proximity_pairs", [" WHERE event_type = 'purchase'"]),
    ("agg21_components_all_events", "agg21_components", [" WHERE event_type = 'purchase'"]),
    ("win02_label_rank_all_zooms", "win02_label_rank", [" WHERE event_type IN ('purchase', 'signup')", "z = 6 AND "]),
    ("srt01_tile_order_all_zooms", "srt01_tile_order", [" WHERE z BETWEEN 3 AND 4"]),
]


@pytest.mark.parametrize("name,part,cuts", WHOLE)
def test_all_rows_and_zooms(spark, tmp_path, name, part, cuts):
    """The SQL of the sibling without its filters, over the events of 25 degrees square."""
    sql = entry.oracle_sql()[part]
    for cut in cuts:
        assert cut in sql
        sql = sql.replace(cut, "")
    db = duckdb.connect()
    db.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE {PLACE}) TO '{tmp_path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    cursor = db.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    assert sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select(*columns).collect()) == want
    assert len(want) > len(db.execute(entry.oracle_sql()[part]).fetchall()) > 0
