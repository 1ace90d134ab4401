import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrane.operators import bloom, orphans

T = [dt.datetime(2024, 1, d) for d in range(1, 20)]
NODES = "id bigint, version int, visible boolean, loaded_at timestamp, reason string"


@pytest.mark.parametrize("words", [1, 256])
def test_bloom_has_no_false_negatives_and_few_false_positives(spark, words):
    keys = spark.range(0, 900, 3).withColumnRenamed("id", "k")
    made = bloom.build(keys, "k", words)
    probed = spark.range(1000).withColumn("hit", bloom.may_contain(F.col("id"), made.scalar(), words))
    rows = {r["id"]: r["hit"] for r in probed.collect()}
    assert all(rows[k] for k in range(0, 900, 3))
    if words == 256:
        assert sum(rows[k] for k in rows if k % 3) < 60
    assert bloom.words_for(10) == 256 and bloom.words_for(10**9) * bloom.KEYS_PER_WORD >= 10**9


@pytest.mark.parametrize("max_words,shard_words", [(1 << 20, 32), (1, 32), (1, 256)])
def test_filter_beyond_the_broadcast_limit_tells_as_well(spark, max_words, shard_words):
    keys = spark.range(0, 900, 3).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,)], "k bigint"))
    rows = {r["id"]: r["maybe"] for r in bloom.marked(spark.range(1000), "id", keys, "k", 300, max_words, shard_words).collect()}
    assert len(rows) == 1000 and all(rows[k] for k in range(0, 900, 3))
    assert sum(rows[k] for k in rows if k % 3) < 60


def test_reasons(spark):
    nodes = [(1, 1, True, T[0]), (2, 1, True, T[0]), (2, 2, False, T[1]), (3, 1, False, T[0]), (3, 2, True, T[1]), (4, 1, True, T[9]), (4, 1, True, T[12]), (5, 1, None, T[0]), (6, 1, True, None), (None, 1, True, T[0]), (7, 1, True, T[5])]
    ways = [(10, [1, 2, 2, 3, 4, None, 99], T[5], T[4]), (10, [1, 2, 2, 3, 4, None, 99], T[8], T[4]), (11, [], T[5], None), (12, None, T[5], None), (13, [5, 6, 7, 99], T[5], None), (None, [99], T[5], None)]
    versions = spark.createDataFrame([(*n, "clash") for n in nodes], NODES)
    refs = orphans.way_references(spark.createDataFrame(ways, "id bigint, node_ids array<bigint>, loaded_at timestamp, edited_at timestamp"))
    for parent_rows, max_words in ((None, 1 << 20), (1, 1 << 20), (None, 1)):
        got = sorted((r["from_id"], r["ref_id"], r["reason"]) for r in orphans.orphan_references(refs, versions, parent_rows, max_words).collect())
        assert got == [(10, 2, "deleted"), (10, 4, "late"), (10, 99, "missing"), (13, 99, "missing")]


def test_members_and_empty_parents(spark):
    members = spark.createDataFrame([(1, 5, T[3], T[1], "x"), (1, 5, T[2], T[1], "x"), (2, None, T[3], T[1], "x")], "membership_id bigint, relation_id bigint, loaded_at timestamp, edited_at timestamp, reason string")
    none = spark.createDataFrame([], NODES)
    got = [tuple(r)[:2] + (r["reason"],) for r in orphans.orphan_references(orphans.member_references(members), none).collect()]
    assert got == [(1, 5, "missing")]
    late = spark.createDataFrame([(5, 1, True, T[2], ""), (5, 2, True, T[1], "")], NODES)
    assert orphans.orphan_references(orphans.member_references(members), late).count() == 0
    assert orphans.orphan_references(orphans.member_references(members.limit(0)), none).count() == 0


def test_hot_reference(spark):
    ways = spark.range(2000).select((F.col("id") + 10).alias("id"), F.array(F.lit(1), F.col("id") % 7 + 2).cast("array<bigint>").alias("node_ids"), F.lit(T[3]).alias("loaded_at"), F.lit(T[3]).alias("edited_at"))
    nodes = spark.createDataFrame([(1, 1, False, T[0], "")], NODES)
    got = orphans.orphan_references(orphans.way_references(ways), nodes).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in got} == {"deleted": 2000, "missing": 2000}
