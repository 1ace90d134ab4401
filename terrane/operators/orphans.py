"""Problem 5: references to records that do not exist, were deleted, or came later.

Method. The keys of the parent table fill a Bloom filter, which is broadcast up to a bounded size and divided into shards of bounded size
beyond it, so that it tells as well with any number of parents. References that it rejects are
definite orphans (``missing``) and never meet the parents; only the rest are verified by an exact join, from which deleted and late
parents and the filter's false positives also come. Counts per table and period follow by aggregation.

Skew. A parent key that a third of all references name makes one heavy join key on the reference side, which adaptive execution
splits; the parent side holds one row per key by then. Versions of one parent id are combined map-side.

Defined results for dirty input: null references are none; repeated references of one referrer count once; a referrer delivered
several times counts as loaded when its first copy was; a parent is late if its first row of any version was loaded after that
(an unknown loading time of either is never late); a null ``visible`` counts as visible; empty tables give an empty result, or all
references missing if only the parents are empty. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import bloom


def parent_states(versions: DataFrame) -> DataFrame:
    """(ref_id, gone, first_loaded) from rows (id, version, visible, loaded_at)."""
    return (
        versions.filter("id is not null")
        .groupBy(F.col("id").alias("ref_id"))
        .agg((~F.coalesce(F.max_by("visible", "version"), F.lit(True))).alias("gone"), F.min("loaded_at").alias("first_loaded"))
    )


def orphan_references(references: DataFrame, versions: DataFrame, parent_rows: int | None = None, max_words: int = bloom.MAX_WORDS) -> DataFrame:
    """(from_id, ref_id, loaded_at, edited_at, reason) of the references (from_id, ref_id, loaded_at, edited_at) that fail.

    ``parent_rows`` is an upper estimate of the parent rows; it only sizes the filter.
    """
    n_keys = versions.count() if parent_rows is None else parent_rows
    marked = bloom.marked(references.filter("ref_id is not null"), "ref_id", versions.select("id"), "id", n_keys, max_words)
    columns = ["from_id", "ref_id", "loaded_at", "edited_at"]
    definite = marked.filter(~F.col("maybe")).select(*columns, F.lit("missing").alias("reason"))
    checked = (
        marked.filter("maybe")
        .join(parent_states(versions).withColumn("known", F.lit(True)), "ref_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("known").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("first_loaded") > F.col("loaded_at"), "late"),
        )
        .filter("reason is not null")
        .select(*columns, "reason")
    )
    return definite.unionByName(checked)


def way_references(ways: DataFrame) -> DataFrame:
    """(from_id, ref_id, loaded_at, edited_at): each distinct node a way names, once per way."""
    one = ways.filter("id is not null").groupBy("id").agg(F.min("loaded_at").alias("loaded_at"), F.min("edited_at").alias("edited_at"), F.first("node_ids", ignorenulls=True).alias("node_ids"))
    return one.select(F.col("id").alias("from_id"), F.explode(F.array_distinct("node_ids")).alias("ref_id"), "loaded_at", "edited_at").filter("ref_id is not null")


def member_references(members: DataFrame) -> DataFrame:
    """(from_id, ref_id, loaded_at, edited_at): the relation each membership belongs to."""
    one = members.filter("membership_id is not null").groupBy("membership_id").agg(F.min("loaded_at").alias("loaded_at"), F.min("edited_at").alias("edited_at"), F.first("relation_id", ignorenulls=True).alias("ref_id"))
    return one.select(F.col("membership_id").alias("from_id"), "ref_id", "loaded_at", "edited_at").filter("ref_id is not null")


def all_orphans(nodes: DataFrame, ways: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """(ref_table, from_id, ref_id, loaded_at, edited_at, reason) over both referring tables."""
    by_way = orphan_references(way_references(ways), nodes).withColumn("ref_table", F.lit("osm_ways"))
    by_member = orphan_references(member_references(members), relations).withColumn("ref_table", F.lit("relation_members"))
    return by_way.unionByName(by_member)
