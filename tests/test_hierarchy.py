import random

import pytest

from terrane.operators import hierarchy

SCHEMA = "parent bigint, child bigint, depth string"


def brute(links):
    parent = {}
    for p, c in links:
        if p is not None and c is not None:
            parent[c] = min(p, parent.get(c, p))
    nodes = set(parent) | set(parent.values())
    want = {}
    for n in nodes:
        path, seen = [n], {n}
        while path[-1] in parent and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        if path[-1] not in parent:
            want[n] = (path[-1], len(path) - 1, "tree", path[::-1])
            continue
        ring = path[path.index(parent[path[-1]]) :]
        if n in ring:
            want[n] = (min(ring), 0, "cycle", [])
        else:
            below = path[: path.index(ring[0])]
            want[n] = (min(ring), len(below), "below_cycle", below[::-1])
    return want


def random_links(seed, n=120):
    rng = random.Random(seed)
    links = [(rng.randrange(k), k) for k in range(1, n) if rng.random() < 0.9]
    links += [(1000, 1001), (1001, 1002), (1002, 1000), (1002, 1003), (1003, 1004), (2000, 2000), (2000, 2001), (3000, 3001), (3001, 3000)]
    links += [(k, k + 1) for k in range(5000, 5040)]  # a chain
    links += [(7000, 7001 + k) for k in range(60)]  # a hub
    links += [links[0]] * 4 + [(None, 5), (6, None), (None, None)]
    return links


@pytest.mark.parametrize("limit", [10**6, 20, 0])
def test_against_brute_force(spark, limit):
    """All components in one task each, only the small ones, and none: every way gives the same rows."""
    links = random_links(limit)
    df = spark.createDataFrame([(*x, "clash") for x in links], SCHEMA)
    got = hierarchy.hierarchies(df, component_rows=limit).collect()
    assert len(got) == len({r["node_id"] for r in got})
    assert {r["node_id"]: (r["root_id"], r["depth"], r["standing"], list(r["path"])) for r in got} == brute(links)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    group = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    got = hierarchy.components(spark.createDataFrame(edges, "parent bigint, child bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == group


def test_descendants(spark):
    tree = spark.createDataFrame([(1, [1]), (2, [1, 2]), (3, [1, 2, 3]), (9, [])], "node_id bigint, path array<bigint>")
    assert {tuple(r) for r in hierarchy.descendants(tree).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_all_descendants_with_cycles(spark, limit):
    links = random_links(limit, 40) + [(2000, 1999), (1999, 1998), (3001, 3002), (3000, 3003)]
    parent = {}
    for p, c in links:
        if p is not None and c is not None:
            parent[c] = min(p, parent.get(c, p))
    want = set()
    for node in parent:
        up, distance, seen = parent[node], 1, set()
        while up is not None and up not in seen:
            seen.add(up)
            want.add((up, node, distance))
            up, distance = parent.get(up), distance + 1
    got = [tuple(r) for r in hierarchy.all_descendants(spark.createDataFrame([(*x, "clash") for x in links], SCHEMA), limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(1000, 1000, 3), (1002, 1001, 2), (2000, 2000, 1), (1001, 1004, 3)} <= want


def test_empty(spark):
    assert hierarchy.all_descendants(spark.createDataFrame([(None, 1, "")], SCHEMA)).count() == 0
    assert hierarchy.hierarchies(spark.createDataFrame([(None, 1, "")], SCHEMA)).count() == 0


def test_unfinished_rounds_are_an_error_and_old_rounds_are_removed(spark):
    import os

    from terrane.session import checkpoint_dir

    links = spark.createDataFrame([(k, k + 1, "") for k in range(64)], SCHEMA).select("parent", "child")
    with pytest.raises(RuntimeError):
        hierarchy.components(links, max_rounds=1)
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert {r["component"] for r in hierarchy.components(links).collect()} == {0}
    left = set(os.listdir(folder)) - before
    assert len(left) <= 1
