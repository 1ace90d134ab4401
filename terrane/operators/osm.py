"""Joins of the node / way / relation graph. Every one is an equi join on ids; order is carried as a position, never assumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(elements: DataFrame, columns: list[str]) -> DataFrame:
    """The visible newest version of each id, however often it was delivered."""
    newest = elements.filter("id is not null").groupBy("id").agg(F.max_by(F.struct(*columns, "visible"), "version").alias("e"))
    return newest.filter("coalesce(e.visible, true)").select("id", *[F.col(f"e.{c}").alias(c) for c in columns])


def way_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, pos, node_id, lon, lat) of the ways (way_id, node_ids) all of whose nodes (id, lon, lat) have a place.

    A single unknown node drops the whole way. One shuffle by node joins, one by way puts the ways together again.
    """
    refs = ways.select("way_id", F.size("node_ids").alias("n"), F.posexplode("node_ids").alias("pos", "node_id"))
    placed = refs.join(nodes.filter("lon is not null and lat is not null").select(F.col("id").alias("node_id"), "lon", "lat"), "node_id")
    found = F.count("*").over(Window.partitionBy("way_id"))
    return placed.withColumn("found", found).filter("found = n").select("way_id", "pos", "node_id", "lon", "lat")


def way_lines(ways: DataFrame, nodes: DataFrame, keep: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """(way_id, line): the ordered coordinates as an array of (lon, lat), with the columns ``keep`` of the ways.

    The columns kept travel with the first reference of each way, not with every one. ``partitions`` fixes the number of tasks for
    kernels that follow.
    """
    keep = keep or []
    first = F.when(F.col("pos") == 0, F.struct(*keep)) if keep else F.lit(None)
    refs = ways.select("way_id", F.size("node_ids").alias("n"), *keep, F.posexplode("node_ids").alias("pos", "node_id")).select("way_id", "n", "pos", "node_id", first.alias("kept"))
    placed = refs.join(nodes.filter("lon is not null and lat is not null").select(F.col("id").alias("node_id"), "lon", "lat"), "node_id")
    if partitions:
        placed = placed.repartition(partitions, "way_id")
    lines = placed.groupBy("way_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"), F.first("kept", ignorenulls=True).alias("kept"))
    return lines.filter("size(p) = n").select("way_id", F.transform("p", lambda c: F.struct(c["lon"].alias("lon"), c["lat"].alias("lat"))).alias("line"), *[F.col(f"kept.{c}").alias(c) for c in keep])


def can_be_polygon(node_ids: Column, tags: Column) -> Column:
    """A closed way of four points at least, unless area=no."""
    return (F.size(node_ids) >= 4) & (F.get(node_ids, F.lit(0)) == F.element_at(node_ids, -1)) & ~F.coalesce(F.try_element_at(tags, F.lit("area")) == "no", F.lit(False))


def can_be_line(node_ids: Column, tags: Column) -> Column:
    """Two points at least; a closed way with area=yes is no line."""
    closed = F.get(node_ids, F.lit(0)) == F.element_at(node_ids, -1)
    return (F.size(node_ids) >= 2) & ~(closed & F.coalesce(F.try_element_at(tags, F.lit("area")) == "yes", F.lit(False)))


def memberships(members: DataFrame, kind: str = "way") -> DataFrame:
    """(member_ref, relations): all relations each member of a kind is in, with its roles."""
    one = members.filter(F.col("member_type") == kind).filter("relation_id is not null and member_ref is not null").select("member_ref", "relation_id", F.coalesce("role", F.lit("")).alias("role")).distinct()
    return one.groupBy("member_ref").agg(F.array_sort(F.collect_list(F.struct("relation_id", "role"))).alias("relations"))


def way_multipolygons(relations: DataFrame, members: DataFrame, ways: DataFrame) -> DataFrame:
    """(relation_id, way_id, member_pos, role, node_ids) for relations of area types with a way member; ways are pruned by a semi join first."""
    areas = relations.filter(F.col("tags")["type"].isin("multipolygon", "boundary", "land_area")).select(F.col("id").alias("relation_id"))
    links = members.filter("member_type = 'way'").join(areas, "relation_id", "left_semi").select("relation_id", F.col("member_ref").alias("way_id"), "member_pos", F.coalesce("role", F.lit("")).alias("role")).distinct()
    return links.join(ways.select("way_id", "node_ids"), "way_id")


def split_at_shared_nodes(ways: DataFrame) -> DataFrame:
    """(way_id, segment, segment_id, first_pos, last_pos, node_ids): ways cut at inner nodes that are used more than once.

    ``segment_id`` = way_id + segment * 10 ** digits of the largest way id. Uses are counted by a pre-aggregated group, not by a
    window over a hot node.
    """
    refs = ways.select("way_id", F.size("node_ids").alias("n"), F.posexplode("node_ids").alias("pos", "node_id"))
    shared = refs.groupBy("node_id").agg(F.count("*").alias("uses")).filter("uses > 1").select("node_id", F.lit(True).alias("shared"))
    cuts = refs.filter("pos > 0 and pos < n - 1").join(shared, "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list("pos")).alias("cuts"))
    step = ways.agg(F.max("way_id").alias("top")).select(F.pow(F.lit(10.0), F.length(F.coalesce("top", F.lit(1)).cast("string"))).cast("bigint").alias("step"))
    bounds = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("node_ids") - 1))
    joined = ways.filter("size(node_ids) >= 2").join(cuts, "way_id", "left").withColumn("b", bounds)
    pieces = joined.select("way_id", "node_ids", "b", F.explode(F.sequence(F.lit(0), F.size("b") - 2)).alias("segment"))
    first, last = F.get("b", F.col("segment")), F.get("b", F.col("segment") + 1)
    return pieces.withColumn("segment_id", F.col("way_id") + F.col("segment") * step.scalar()).select("way_id", "segment", "segment_id", first.alias("first_pos"), last.alias("last_pos"), F.slice("node_ids", first + 1, last - first + 1).alias("node_ids"))


def ancestors(links: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, distance, path) from links (parent, child), safe against cycles; see the hierarchy operator."""
    from terrane.operators.hierarchy import descendants, hierarchies

    tree = hierarchies(links)
    return descendants(tree).select(F.col("descendant_id").alias("node_id"), "ancestor_id", "distance")


def node_bounds(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
