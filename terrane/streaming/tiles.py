"""Event streams on tiles: windowed counts with late data, sessions, and a label limit kept as state per cell."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrane.functions import geo


def placed(events: DataFrame) -> DataFrame:
    id_ = F.col("event_id")
    lon, lat = ((id_ * 7919) % 360000).cast("double") / 1000 - 180, ((id_ * 104729) % 170000).cast("double") / 1000 - 85
    return events.withColumn("wx", geo.world_x(lon)).withColumn("wy", geo.world_y(lat)).withColumn("at", F.col("ts").cast("timestamp"))


def windowed_tile_counts(events: DataFrame, zoom: int = 4, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per tile and window; rows later than ``late`` behind the newest are dropped and counted by the engine."""
    span = F.window("at", window, slide) if slide else F.window("at", window)
    tiles = placed(events).withWatermark("at", late).withColumn("x", geo.tile_column(F.col("wx"), F.lit(zoom))).withColumn("y", geo.tile_column(F.col("wy"), F.lit(zoom)))
    return tiles.groupBy(span.alias("w"), "x", "y").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "x", "y", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events with pauses below ``gap``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("s.start", "s.end", "user_id", "n")


def limited_labels(events: DataFrame, zoom: int = 6, grid_px: float = 32.0, limit: int = 3) -> DataFrame:
    """Labels that enter the first ``limit`` of their grid cell when they arrive, dearest first; the state is ``limit`` numbers per cell."""
    side = float(1 << zoom)
    celled = placed(events).withColumn("cell", geo.label_grid_id(F.col("wx") * side, F.col("wy") * side, F.lit(grid_px / 256)))

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = list(state.get[0]) if state.exists else []
        out = []
        for frame in frames:
            for id_, value in sorted(zip(frame["event_id"], frame["value"]), key=lambda p: (-p[1], p[0])):
                if len(best) < limit or value > best[-1]:
                    best = sorted([*best, float(value)], reverse=True)[:limit]
                    out.append((key[0], id_, value))
        state.update((best,))
        yield pd.DataFrame(out, columns=["cell", "event_id", "value"])

    return celled.select("cell", "event_id", "value").groupBy("cell").applyInPandasWithState(keep, "cell bigint, event_id bigint, value double", "best array<double>", "update", GroupStateTimeout.NoTimeout)
