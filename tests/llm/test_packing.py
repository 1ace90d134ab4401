import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 9)), min_size=1, max_size=7, unique_by=lambda x: x[0]), st.integers(1, 4))
def test_buckets_have_least_padding(hist, buckets):
    hist.sort()
    size, count = np.array([a for a, _ in hist]), np.array([b for _, b in hist])

    def padding(bounds):
        at = np.searchsorted(bounds, size)
        return int(((np.array(bounds)[at] - size) * count).sum())

    got = packing.optimal_buckets(size, count, buckets)
    assert len(got) <= buckets and got[-1] == size[-1]
    best = min(padding(sorted({*c, size[-1]})) for k in range(1, buckets + 1) for c in itertools.combinations(size.tolist(), min(k, len(size))) if len({*c, size[-1]}) <= buckets)
    assert padding(got) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 20), min_size=1, max_size=12))
def test_patterns_use_up_the_counts_and_fit(hist):
    size = np.array(sorted(hist))
    counts = np.array([hist[s] for s in size.tolist()])
    for buckets in (None, 1, 2, 5):
        used = Counter()
        patterns, n = packing.plan_buckets(size, counts, 50, buckets)
        bounds = packing.optimal_buckets(size, counts, n)
        for pattern, times in patterns:
            assert sum(pattern) <= 50 and times > 0
            assert len(set(np.searchsorted(bounds, pattern).tolist())) == 1  # a batch stays inside its bucket
            used.update({s: n * times for s, n in Counter(pattern).items()})
        assert used == Counter(hist)


def test_number_of_buckets_is_the_one_that_leaves_least():
    size, counts = np.array([2, 8, 30, 31, 49]), np.array([60, 20, 7, 9, 40])
    need = {k: sum(n for _, n in packing.plan_buckets(size, counts, 50, k)[0]) for k in (1, 2, 4)}
    patterns, chosen = packing.plan_buckets(size, counts, 50)
    assert sum(n for _, n in patterns) == min(need.values())
    assert packing.plan_buckets(np.array([25, 50]), np.array([4, 4]), 50)[1] == 2  # as little room, more buckets
    assert packing.plan_buckets(np.array([], dtype=int), np.array([], dtype=int), 50) == ([], 0)


@pytest.mark.parametrize("buckets", [None, 3])
@pytest.mark.parametrize("group_rows", [7, 10_000])
def test_every_token_is_in_one_container(spark, buckets, group_rows):
    rng = random.Random(3)
    rows = [(k, rng.choice([0, 3, 3, 3, 10, 40, 64, 65, 128, 300])) for k in range(400)] + [(5, 10), (5, 10), (None, 7)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), capacity=64, buckets=buckets, group_rows=group_rows).collect()
    per = defaultdict(int)
    for r in out:
        per[r["container_id"]] += r["n_tokens"]
    assert max(per.values()) <= 64
    want = Counter()
    for key, n in rows:
        for at in range(0, n, 64):
            want[key, at // 64, at, min(64, n - at)] += 1
    assert Counter((r["doc_id"], r["part"], r["first_token"], r["n_tokens"]) for r in out) == want


def test_pattern_plan_leaves_little_room(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(1, 2500)) for k in range(3000)]
    report = packing.fill_report(packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"))).first()
    assert report["n_tokens"] == sum(n for _, n in rows)
    assert report["room_left"] < 0.005 and report["n_containers"] >= report["least_containers"] and report["most_used"] <= 2048


def test_empty(spark):
    empty = packing.pack(spark.createDataFrame([(1, 0)], "doc_id bigint, n_tokens bigint"))
    assert empty.count() == 0
    assert packing.fill_report(empty).first()["n_containers"] == 0
    assert packing.fill_by_buckets(spark.createDataFrame([(1, 0)], "doc_id bigint, n_tokens bigint")).count() == 0


def test_lengths_of_dirty_texts(spark):
    rows = [(1, "hello world", "x"), (2, "", "y"), (3, None, "z"), (4, "a b " * 20_000, "")]
    out = {r["doc_id"]: r["n_tokens"] for r in packing.document_lengths(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")).collect()}
    assert out[1] == 2 and out[2] == out[3] == 0 and out[4] > 30_000
