"""Problem 6: filling containers of fixed capacity with items that are not divided unless one alone is larger.

Method: optimal length buckets. The global histogram of item lengths, which has at most ``capacity`` bins, is all that reaches the driver.
Dynamic programming over it chooses the boundaries of length buckets that minimise padding, and token-budget batches form
inside each bucket: every batch starts from the largest length left in the bucket and is filled up to the budget with its real lengths,
found as a subset sum, and is repeated while the counts last. How many buckets there are is chosen by the histogram as well: of
1, 2, 4, ... ``BUCKETS`` buckets those that leave the least room, more of them where several leave as little. A length near the capacity
needs short items to fill its container up, so narrow buckets can leave much room (``fill_by_buckets`` reports it).

Items get their places without any task seeing a whole bucket: items are ranked in (length, salt) groups, the groups' counts
give offsets, and the rank of an item within its length names its container through the plan, which has a few rows per
length. Items above the capacity are cut into full containers and one remainder, which is packed like any other item.

Defined results for dirty input: null and empty texts have no tokens and are in no container; equal lengths are ranked by key;
repeated rows are packed once each; an empty table gives no containers; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import durable

CAPACITY = 2048
#: The most buckets tried.
BUCKETS = 64
#: Items that one ranking group should hold.
GROUP_ROWS = 100_000


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding; ``lengths`` ascend."""
    n = len(lengths)
    if n <= buckets:
        return lengths.copy()
    c = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    # cost[i, j]: padding of one bucket over the lengths i..j (exclusive of i, one-based)
    upto = np.arange(1, n + 1)
    cost = lengths[None, :] * (c[upto][None, :] - c[:n][:, None]) - (s[upto][None, :] - s[:n][:, None])
    cost[np.arange(n)[:, None] > np.arange(n)[None, :]] = np.inf
    best, cut = cost[0].copy(), []
    for _ in range(buckets - 1):
        total = np.concatenate([[np.inf], best[:-1]])[:, None] + cost
        choice = total.argmin(axis=0)
        better = total[choice, np.arange(n)]
        use = better < best
        cut.append(np.where(use, choice, -1))
        best = np.where(use, better, best)
    bounds, j = [n - 1], n - 1
    for choice in reversed(cut):
        if choice[j] > 0:
            j = int(choice[j]) - 1
            bounds.append(j)
    return lengths[sorted(set(bounds))]


def _fill(room: int, sizes: list[int], left: dict[int, int]) -> list[int]:
    """Sizes from ``left`` whose sum comes as near to ``room`` as can be, few and large ones preferred."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int]] = []
    for size in sizes:  # descending
        if size > room:
            continue
        for _ in range(min(left[size], room // size)):
            grown = reach | (reach << size) & mask
            if grown == reach:
                break
            steps.append((size, reach))
            reach = grown
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = []
    for size, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(size)
            total -= size
    return chosen


def plan_patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (sizes in one container, how many such containers) that use up all counts; every size is at most ``capacity``."""
    left = {int(k): int(n) for k, n in zip(sizes, counts) if n > 0}
    patterns = []
    while left:
        order = sorted(left, reverse=True)
        top = order[0]
        left[top] -= 1
        pattern = [top, *_fill(capacity - top, order, left)]
        left[top] += 1
        need: dict[int, int] = {}
        for size in pattern:
            need[size] = need.get(size, 0) + 1
        times = min(left[size] // k for size, k in need.items())
        patterns.append((pattern, times))
        for size, k in need.items():
            left[size] -= k * times
            if not left[size]:
                del left[size]
    return patterns


def plan_buckets(sizes: np.ndarray, counts: np.ndarray, capacity: int, buckets: int | None = None) -> tuple[list[tuple[list[int], int]], int]:
    """Batches that stay inside their length bucket, and the number of buckets: as given, or the one that needs the fewest containers."""
    if not len(sizes):
        return [], 0
    best: tuple[int, int] | None = None
    chosen: tuple[list, int] = ([], 0)
    for k in [buckets] if buckets else [1 << e for e in range(BUCKETS.bit_length()) if 1 << e <= BUCKETS]:
        at = np.searchsorted(optimal_buckets(sizes, counts, k), sizes)
        n = int(at.max()) + 1
        tokens = np.bincount(at, sizes * counts, minlength=n)
        if best is not None and np.ceil(tokens / capacity).sum() > best[0]:
            continue  # it cannot need fewer
        patterns = [p for b in range(n) for p in plan_patterns(sizes[at == b], counts[at == b], capacity)]
        needed = sum(times for _, times in patterns)
        if best is None or (needed, -n) < best:
            best, chosen = (needed, -n), (patterns, n)
    return chosen


def _ranked(items: DataFrame, key: str, salts: int) -> DataFrame:
    """Adds ``rank`` from 0 within each length ``rest``, by salted groups."""
    salted = items.withColumn("salt", F.pmod(F.xxhash64(key, F.lit(3)), F.lit(salts)).cast("int"))
    groups = salted.groupBy("rest", "salt").agg(F.count("*").alias("n"))
    offsets = groups.select("rest", "salt", (F.sum("n").over(Window.partitionBy("rest").orderBy("salt")) - F.col("n")).alias("offset"))
    local = salted.withColumn("local", F.row_number().over(Window.partitionBy("rest", "salt").orderBy(key, "n_tokens")))
    return local.join(offsets, ["rest", "salt"]).withColumn("rank", F.col("offset") + F.col("local") - 1).drop("offset", "local", "salt")


def pack(lengths: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, buckets: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(container_id, key, part, first_token, n_tokens) from ``lengths`` (key, n_tokens).

    ``lengths`` is read several times; pass a written or checkpointed table. Without ``buckets`` their number is chosen.
    """
    spark = lengths.sparkSession
    whole = lengths.filter("n_tokens > 0").select(key, (F.col("n_tokens") % capacity).cast("int").alias("rest"), F.floor(F.col("n_tokens") / capacity).cast("bigint").alias("full"), "n_tokens")
    seen = whole.groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).toPandas()  # at most `capacity` rows
    n_rows = int(seen["n"].sum()) if len(seen) else 0
    salts = max(1, -(-n_rows // group_rows))
    hist = seen[seen["rest"] > 0].sort_values("rest")
    size, count = hist["rest"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    schema = "container_id bigint, `{0}` {1}, part int, first_token bigint, n_tokens bigint".format(key, lengths.schema[key].dataType.simpleString())
    if not n_rows:
        return spark.createDataFrame([], schema)
    rows, base = [], 0
    given = dict.fromkeys(size.tolist(), 0)
    for pattern, times in plan_buckets(size, count, capacity, buckets)[0]:
        for rest in set(pattern):
            amount = pattern.count(rest) * times
            rows.append((rest, given[rest], given[rest] + amount, base, times))
            given[rest] += amount
        base += times
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, 1)], "rest int, since bigint, until bigint, base bigint, times bigint")  # a few rows per length
    placed = _ranked(whole.filter("rest > 0"), key, salts).join(F.broadcast(plan), "rest").filter("rank >= since and rank < until")
    rests = placed.select((F.col("base") + (F.col("rank") - F.col("since")) % F.col("times")).alias("container_id"), key, F.col("full").cast("int").alias("part"), (F.col("full") * capacity).alias("first_token"), F.col("rest").cast("bigint").alias("n_tokens"))
    if not int(seen["full"].sum()):
        return rests
    long = whole.filter("full > 0").withColumn("salt", F.pmod(F.xxhash64(key, F.lit(3)), F.lit(salts)).cast("int"))
    sums = long.groupBy("salt").agg(F.sum("full").alias("s"))
    offsets = sums.select("salt", (F.sum("s").over(Window.orderBy("salt")) - F.col("s")).alias("offset"))  # one row per salt
    run = F.sum("full").over(Window.partitionBy("salt").orderBy(key, "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = long.withColumn("run", run).join(offsets, "salt").select(key, "full", (F.lit(base) + F.col("offset") + F.col("run") - F.col("full")).alias("first"), F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("part"))
    fulls = cut.select((F.col("first") + F.col("part")).alias("container_id"), key, "part", (F.col("part").cast("bigint") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    return fulls.unionByName(rests)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the fewest containers that could hold them, and the share of room left."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return each.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.ceil(F.sum("used") / capacity), F.lit(0)).alias("least_containers"), F.coalesce(F.max("used"), F.lit(0)).alias("most_used"),
        F.coalesce(F.round(1 - F.sum("used") / (F.count("*") * capacity), 6), F.lit(0.0)).alias("room_left"),
    )


def fill_by_buckets(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_buckets, n_containers, least_containers, room_left) by number of buckets; ``chosen`` marks the one that ``pack`` takes."""
    whole = lengths.filter("n_tokens > 0").select((F.col("n_tokens") % capacity).cast("int").alias("rest"), F.floor(F.col("n_tokens") / capacity).cast("bigint").alias("full"))
    seen = whole.groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).toPandas()  # at most `capacity` rows
    hist = seen[seen["rest"] > 0].sort_values("rest")
    size, count, full = hist["rest"].to_numpy(np.int64), hist["n"].to_numpy(np.int64), int(seen["full"].sum()) if len(seen) else 0
    chosen = plan_buckets(size, count, capacity)[1]
    tokens = int((size * count).sum()) + full * capacity
    rows = []
    for k in [1 << e for e in range(BUCKETS.bit_length())] if tokens else []:
        patterns, n = plan_buckets(size, count, capacity, k)
        needed = sum(times for _, times in patterns) + full
        rows.append((n, needed, -(-tokens // capacity), round(1 - tokens / (needed * capacity), 6), n == chosen))
    return lengths.sparkSession.createDataFrame(rows, "n_buckets int, n_containers bigint, least_containers bigint, room_left double, chosen boolean").distinct()


def document_lengths(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    from terrane.llm.tokens import VOCABULARY, token_counts

    return durable(token_counts(documents, ["doc_id"], vocabulary=vocabulary or VOCABULARY))
