"""Group-at-a-time processing of partitions that are already shuffled and sorted by the group's key.

Unlike ``applyInPandas`` the consumer may yield many small frames for one group, so output never has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd


def sorted_groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Yield one frame per run of equal keys in a stream of frames that is sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    last: tuple = ()
    for frame in frames:
        if frame.empty:
            continue
        columns = [frame[k].to_numpy() for k in keys]
        change = np.zeros(len(frame) - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(frame)]
        for start, end in zip(bounds, bounds[1:]):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[start:end])
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def over_groups(df, keys: list[str], function: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str, partitions: int | None = None):
    """Shuffle by ``keys``, sort, and apply a generator to each group.

    Without ``partitions`` adaptive execution may join small partitions; kernels that are heavy for their bytes should fix the number.
    """
    spread = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, keys):
            yield from function(group)

    return spread.sortWithinPartitions(*keys).mapInPandas(run, schema)


def over_some_groups(df, active, keys: list[str], function: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str, spread_by: str = "id"):
    """``over_groups`` for the rows where ``active`` holds; the others pass by in the same stage, spread evenly, frame by frame.

    What comes before runs once, which two filters and a union of it would not.
    """
    from pyspark.sql import functions as F

    tagged = df.withColumn("_active", F.coalesce(active, F.lit(False)))
    spread = F.when(F.col("_active"), 0).otherwise(1 + F.pmod(F.xxhash64(spread_by), F.lit(1024)))
    placed = tagged.repartition(kernel_partitions(df), *keys, spread).sortWithinPartitions("_active", *keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def awake() -> Iterator[pd.DataFrame]:
            for frame in frames:
                flags = frame.pop("_active").to_numpy(bool)
                yield (frame[flags], frame[~flags])

        held = awake()
        waiting: list[pd.DataFrame] = []
        for some, rest in held:  # sorted, so the idle rows come first
            if len(rest):
                yield rest
            if len(some):
                waiting.append(some)
                break

        def others() -> Iterator[pd.DataFrame]:
            yield from waiting
            for some, _ in held:
                yield some

        for group in sorted_groups(others(), keys):
            yield from function(group)

    return placed.mapInPandas(run, schema)


def whole_groups(batches: Iterable, keys: list[str]) -> Iterator[tuple]:
    """(batch, row at which each group starts) of a stream of Arrow batches that is sorted by ``keys``; a batch holds whole groups, as many as came."""

    def row(batch, k: int) -> tuple:
        return tuple(batch.column(c)[k].as_py() for c in keys)

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and row(held[0], 0) == row(batch, batch.num_rows - 1):
            held.append(batch)  # still the same group
            continue
        joined = one_batch([*held, batch])
        starts = group_starts(joined, keys)
        if len(starts) > 1:
            yield joined.slice(0, int(starts[-1])), starts[:-1]
        held = [joined.slice(int(starts[-1]))]
    if held:
        joined = one_batch(held)
        yield joined, group_starts(joined, keys)


def group_starts(batch, keys: list[str]) -> np.ndarray:
    """The row at which each run of equal keys of an Arrow batch starts."""
    import pyarrow as pa

    change = np.zeros(batch.num_rows, dtype=bool)
    change[:1] = True
    for c in keys:
        column = batch.column(c)
        values = column.dictionary_encode().indices.fill_null(-1) if pa.types.is_string(column.type) else column
        values = values.to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def one_batch(batches: list):
    import pyarrow as pa

    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow list column and the offsets of its rows in them; a null row is empty."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0))]).astype(np.int64)


#: Bytes of source files that one task of a kernel should take.
KERNEL_BYTES = 32 << 20


def kernel_partitions(df) -> int:
    """How many tasks a CPU-bound kernel should have: two a core and the session's shuffle partitions at least, more where the files read are large or the rows were made in more."""
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [found.apply(k) for k in range(found.size())]
    # a checkpointed leaf keeps the optimizer's guess of the plan before it, which after joins is far too large; its partitions are known
    made = [leaf.rdd().getNumPartitions() for leaf in leaves if leaf.nodeName() == "LogicalRDD"]
    sizes = [int(str(leaf.stats().sizeInBytes())) for leaf in leaves if leaf.nodeName() != "LogicalRDD"]
    return max(least, *made, -(-sum(n for n in sizes if n < 1 << 60) // KERNEL_BYTES))  # a leaf of unknown size is told by a huge one
