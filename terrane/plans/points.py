"""Derived inputs that several queries share, in both dialects.

The event table has no geometry, so each event gets a place computed from its id; both engines compute it the same way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.plans.registry import Tables

EVENT_POINTS = (
    "SELECT *, CAST((event_id * 7919) % 360000 AS DOUBLE) / 1000 - 180 AS lon, CAST((event_id * 104729) % 170000 AS DOUBLE) / 1000 - 85 AS lat FROM events"
)
WORLD_Y = "(CASE WHEN lat > 85.0511287798066 THEN -0.1 WHEN lat < -85.0511287798066 THEN 1.1 ELSE 0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) * (0.25 / pi()) END)"
EVENTS = f"ev AS (SELECT *, (lon + 180) / 360 AS wx, {WORLD_Y} AS wy FROM ({EVENT_POINTS}) e)"


def event_points(t: Tables):
    """Events with lon, lat and world coordinates wx, wy."""
    id_ = F.col("event_id")
    placed = t("events").withColumn("lon", ((id_ * 7919) % 360000).cast("double") / 1000 - 180).withColumn("lat", ((id_ * 104729) % 170000).cast("double") / 1000 - 85)
    return placed.withColumn("wx", geo.world_x(F.col("lon"))).withColumn("wy", geo.world_y(F.col("lat")))


# current versions of the map elements, in both dialects
NODES = "node AS (SELECT id, arg_max(struct_pack(lat := lat, lon := lon, tags := tags, visible := visible), version) AS e FROM osm_nodes WHERE id IS NOT NULL GROUP BY id), cur_node AS (SELECT id, e.lat AS lat, e.lon AS lon, e.tags AS tags FROM node WHERE coalesce(e.visible, TRUE))"
WAYS = "way AS (SELECT id, arg_max(struct_pack(node_ids := node_ids, tags := tags, visible := visible), version) AS e FROM osm_ways WHERE id IS NOT NULL GROUP BY id), cur_way AS (SELECT id AS way_id, list_filter(e.node_ids, lambda n: n IS NOT NULL) AS node_ids, e.tags AS tags FROM way WHERE coalesce(e.visible, TRUE) AND e.node_ids IS NOT NULL)"
RELATIONS = "rel AS (SELECT id, arg_max(struct_pack(tags := tags, visible := visible), version) AS e FROM osm_relations WHERE id IS NOT NULL GROUP BY id), cur_rel AS (SELECT id, e.tags AS tags FROM rel WHERE coalesce(e.visible, TRUE))"


def current_nodes(t: Tables):
    from terrane.operators.osm import current

    return current(t("osm_nodes"), ["lat", "lon", "tags"])


def current_ways(t: Tables):
    from terrane.operators.osm import current

    return current(t("osm_ways"), ["node_ids", "tags"]).filter("node_ids is not null").select(F.col("id").alias("way_id"), F.array_compact("node_ids").alias("node_ids"), "tags")


def current_relations(t: Tables):
    from terrane.operators.osm import current

    return current(t("osm_relations"), ["tags"])


def tags_text(tags):
    """A map as sorted k=v text, for results that are compared by value."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ";")


TAGS_TEXT = "array_to_string(list_sort(list_transform(map_entries({0}), lambda e: concat(e.key, '=', coalesce(e.value, '')))), ';')"
