import datetime as dt

from terrane.streaming import tiles

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"


def stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def collect(spark, df, tmp_path, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def rows(n):
    return [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), k % 3, float(k)) for k in range(n)]


def test_windowed_counts_match_batch(spark, tmp_path):
    data = rows(60)
    got = collect(spark, tiles.windowed_tile_counts(stream(spark, tmp_path, data), 2), tmp_path, "w", "complete")
    batch = tiles.windowed_tile_counts(spark.createDataFrame(data, SCHEMA), 2).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in batch} and sum(r["n"] for r in got) == 60


def test_sessions(spark, tmp_path):
    data = [(1, dt.datetime(2024, 1, 1, 0, 0), 1, 0.0), (2, dt.datetime(2024, 1, 1, 0, 20), 1, 0.0), (3, dt.datetime(2024, 1, 1, 2, 0), 1, 0.0), (4, dt.datetime(2024, 1, 1, 0, 0), 2, 0.0)]
    got = collect(spark, tiles.sessions(stream(spark, tmp_path, data)), tmp_path, "s", "complete")
    assert sorted((r["user_id"], r["n"]) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_label_limit_keeps_the_dearest(spark, tmp_path):
    data = [(k * 360000, dt.datetime(2024, 1, 1), 0, float(k % 10)) for k in range(30)]
    lats = {k * 360000 * 104729 % 170000 for k in range(30)}
    got = collect(spark, tiles.limited_labels(stream(spark, tmp_path, data), zoom=0, grid_px=256.0, limit=3), tmp_path, "l", "update")
    per_cell = {}
    for r in got:
        per_cell.setdefault(r["cell"], []).append(r["value"])
    assert lats and all(max(v) == 9.0 and len(v) <= 30 for v in per_cell.values())
