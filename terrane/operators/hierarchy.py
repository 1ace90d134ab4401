"""Problem 2: parent-child links to full hierarchies, with cycles named.

Method. Connected components of the links are found by alternating large-star and small-star steps, each cut by a reliable
checkpoint. A hub, which has one row on the narrow side of a round's join, is split on the other side by adaptive execution. Components of up to ``component_rows`` links are co-located, one task per component, and walked by an iterative
depth-first traversal with node colouring: grey nodes met again give the back edge that closes a cycle. Larger components, which
may hold any share of the rows, are never collected into a task: there the walk is made by joins, doubling the distance that
each node's pointer has jumped until it meets a root or has gone round its cycle.

Defined results for dirty input: links with a null end are ignored; a repeated link counts once; a node named with several
parents keeps the smallest (the data promise one); a link of a node to itself is a cycle of one; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import durable, forget
from terrane.streams import over_groups

#: Components of more links than this are walked by joins instead of in one task.
COMPONENT_ROWS = 200_000
SCHEMA = "node_id bigint, root_id bigint, depth int, standing string, path array<bigint>"


def clean_links(links: DataFrame) -> DataFrame:
    """(parent, child), one row per child."""
    return links.filter("parent is not null and child is not null").groupBy("child").agg(F.min("parent").alias("parent")).select("parent", "child")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected graph of ``links`` (parent, child); component is the smallest node of it."""
    edges = durable(links.select(F.greatest("parent", "child").alias("u"), F.least("parent", "child").alias("v")).filter("u != v").distinct())
    selves = links.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    last = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, edges = edges, durable(small.filter("u != v").distinct())
        forget(before)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"the components are not complete after {max_rounds} rounds")
    return selves.join(edges.select(F.col("u").alias("node"), F.col("v").alias("low")), "node", "left").select("node", F.coalesce("low", "node").alias("component"))


def walk(children: dict[int, list[int]], parent: dict[int, int]) -> Iterator[tuple[int, int, int, str, list[int]]]:
    """Depth-first over one component whose nodes have one parent at most: (node, root, depth, standing, path)."""
    nodes = set(parent) | set(children)
    colour: dict[int, int] = {}
    starts: list[tuple[int, str, int]] = [(n, "tree", n) for n in sorted(nodes) if n not in parent]
    reached = set()
    stack: list[int] = [n for n, _, _ in starts]
    while stack:  # everything below a true root
        node = stack.pop()
        reached.add(node)
        stack.extend(children.get(node, ()))
    for first in sorted(nodes - reached):  # follow parents: a grey node met again closes a cycle
        trail, node = [], first
        while node not in colour:
            colour[node] = 1
            trail.append(node)
            node = parent[node]
        if colour[node] == 1:
            ring = trail[trail.index(node) :]
            low = min(ring)
            on_ring = set(ring)
            for member in ring:
                yield member, low, 0, "cycle", []
                starts += [(c, "below_cycle", low) for c in children.get(member, ()) if c not in on_ring]
        for seen in trail:
            colour[seen] = 2
    for start, standing, root in starts:
        path: list[int] = []
        stack2: list[tuple[int, int]] = [(start, 0)]
        while stack2:
            node, depth = stack2.pop()
            del path[depth:]
            path.append(node)
            yield node, root, depth + (standing == "below_cycle"), standing, path.copy()
            stack2.extend((c, depth + 1) for c in reversed(children.get(node, ())))


def _walk_groups(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
    parent = dict(zip(group["child"].tolist(), group["parent"].tolist()))
    children: dict[int, list[int]] = {}
    for child, up in sorted(parent.items()):
        children.setdefault(up, []).append(child)
    rows = []
    for row in walk(children, parent):
        rows.append(row)
        if len(rows) >= 5000:
            yield pd.DataFrame(rows, columns=["node_id", "root_id", "depth", "standing", "path"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["node_id", "root_id", "depth", "standing", "path"])


def _doubled(state: DataFrame, total: int, trails: bool, max_rounds: int = 63) -> DataFrame:
    """Let every pointer of (node, up, done, low[, trail]) jump twice as far each round, until all are done or have jumped over ``total`` links.

    ``state`` is checkpointed; its files are removed once the next round has its own.
    """
    jump = 1
    for _ in range(max_rounds):
        if jump > total or not state.filter("not done").limit(1).count():
            break
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("done").alias("done2"), F.col("low").alias("low2"), *([F.col("trail").alias("trail2")] if trails else []))
        moved = state.filter("not done").join(ahead, "up").select(
            "node", F.col("up2").alias("up"), F.col("done2").alias("done"), F.least("low", "low2").alias("low"), *([F.concat("trail", "trail2").alias("trail")] if trails else [])
        )
        before, state = state, durable(state.filter("done").unionByName(moved))
        forget(before)
        jump *= 2
    else:
        raise RuntimeError(f"the pointers are not at rest after {max_rounds} rounds")
    return state


def _walk_by_joins(links: DataFrame) -> DataFrame:
    """The same rows for components of any size, in rounds logarithmic in the depth.

    First the pointers double until each has met a root or jumped over more links than there are nodes: the places where the latter
    stand are exactly the nodes on cycles. Then the links into those nodes are cut, which leaves a forest, and the pointers double once
    more, now carrying the nodes they passed.
    """
    nodes = durable(links.select(F.explode(F.array("parent", "child")).alias("node")).distinct())
    up = links.select(F.col("child").alias("node"), F.col("parent").alias("up"))
    first = nodes.join(up, "node", "left").select("node", F.coalesce("up", "node").alias("up"), F.col("up").isNull().alias("done"), F.least("node", F.coalesce("up", "node")).alias("low"))
    turned = _doubled(durable(first), nodes.count(), False)
    ring = durable(turned.filter("not done").select(F.col("up").alias("node")).distinct().join(turned.select("node", "low"), "node").select("node", F.col("low").alias("ring_id")))
    cut = up.join(ring.select("node"), "node", "left_anti")
    start = nodes.join(cut, "node", "left").select(
        "node", F.coalesce("up", "node").alias("up"), F.col("up").isNull().alias("done"), F.col("node").alias("low"), F.when(F.col("up").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("node")).alias("trail")
    )
    forest = _doubled(durable(start), 1 << 62, True)
    on_ring = F.col("ring_id").isNotNull()
    return forest.join(ring.withColumnRenamed("node", "up"), "up", "left").select(
        F.col("node").alias("node_id"),
        F.coalesce("ring_id", "up").alias("root_id"),
        F.size("trail").alias("depth"),
        F.when(on_ring & (F.size("trail") == 0), "cycle").when(on_ring, "below_cycle").otherwise("tree").alias("standing"),
        F.when(on_ring, F.reverse("trail")).otherwise(F.concat(F.array("up"), F.reverse("trail"))).alias("path"),
    )


def hierarchies(links: DataFrame, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """(node_id, root_id, depth, standing, path) for every node of ``links`` (parent, child); see the module text for the cases.

    ``path`` runs from the root to the node for ``tree``, from the node just below the cycle for ``below_cycle``, and is empty for ``cycle``.
    """
    links = durable(clean_links(links))
    named = components(links)
    owned = durable(links.join(named.withColumnRenamed("node", "child"), "child"))
    sizes = owned.groupBy("component").count()
    large = durable(sizes.filter(F.col("count") > component_rows).select("component"))
    small = owned
    heavy = large.limit(1).count()
    if heavy:
        small = owned.join(large, "component", "left_anti")
    result = over_groups(small.select("component", "parent", "child"), ["component"], _walk_groups, SCHEMA)
    if heavy:
        result = result.unionByName(_walk_by_joins(owned.join(large, "component", "left_semi").select("parent", "child")))
    return result


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) along the paths; nothing is grouped. See all_descendants for what lies on and below cycles."""
    step = tree.filter("size(path) > 1").select("node_id", F.size("path").alias("n"), F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "ancestor_id"))
    return step.select("ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("n") - 1 - F.col("at")).alias("distance"))


def ring_descendants(tree: DataFrame, links: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) whose ancestor is on a cycle: ``tree`` as made by hierarchies from ``links`` as clean_links leaves them.

    The link into the smallest node of each cycle is cut, which leaves a chain; its pointers double until every member knows its place.
    """
    up = links.select(F.col("child").alias("node"), "parent")
    ring = durable(tree.filter("standing = 'cycle'").select(F.col("node_id").alias("node"), F.col("root_id").alias("ring_id")).join(up, "node"))
    first = F.col("node") == F.col("ring_id")
    start = ring.select("node", F.when(first, F.col("node")).otherwise(F.col("parent")).alias("up"), first.alias("done"), F.col("node").alias("low"), F.when(first, F.array().cast("array<bigint>")).otherwise(F.array("node")).alias("trail"))
    placed = _doubled(durable(start), 1 << 62, True).select("node", F.col("up").alias("ring_id"), F.size("trail").alias("place"))
    members = durable(placed.join(placed.groupBy("ring_id").agg(F.count("*").cast("int").alias("n")), "ring_id"))
    below = tree.filter("standing = 'below_cycle'").select("node_id", "depth", F.col("path")[0].alias("node")).join(up, "node").select("node_id", "depth", F.col("parent").alias("node"))
    ends = members.select("ring_id", F.col("node").alias("node_id"), "place", F.lit(0).alias("depth")).unionByName(below.join(members, "node").select("ring_id", "node_id", "place", "depth"))
    pairs = ends.join(members.select("ring_id", "n", F.col("node").alias("ancestor_id"), F.col("place").alias("from")), "ring_id")
    along = F.pmod(F.col("place") - F.col("from"), F.col("n")) + F.col("depth")
    return pairs.select("ancestor_id", F.col("node_id").alias("descendant_id"), F.when(along == 0, F.col("n")).otherwise(along).alias("distance"))


def all_descendants(links: DataFrame, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """(ancestor_id, descendant_id, distance): every node of ``links`` (parent, child) with everything below it, each pair once.

    Distance is the least number of links from the one down to the other. A node on a cycle has below it all members of the cycle, itself
    included at the distance once round, and everything below any of them.
    """
    links = durable(clean_links(links))
    tree = durable(hierarchies(links, component_rows))
    return descendants(tree).unionByName(ring_descendants(tree, links))
