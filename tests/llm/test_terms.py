import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import terms

SCHEMA = "key bigint, layer string, field string, record bigint, value string, extra string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", max_size=6), st.integers(1, 5), st.integers(0, 3)), max_size=80), st.integers(1, 6))
def test_trie_counts_like_a_dictionary(rows, burst_at):
    trie, want, seen = terms.BurstTrie(burst_at), defaultdict(lambda: [0, 0]), set()
    for term, o, r in sorted(rows, key=lambda row: row[2]):
        trie.add(term, o, r + 1)
        want[term][0] += o
        want[term][1] += (term, r) not in seen
        seen.add((term, r))
    got = list(trie.items())
    assert [t for t, _, _ in got] == sorted(want)
    assert {t: [o, r] for t, o, r in got} == dict(want)
    assert trie.size == len(want)


def test_routes_are_sorted_and_begin_with_the_empty_prefix():
    cuts = terms.route_prefixes([f"aa{k}" for k in range(500)] + ["b", "c"], 16)
    assert cuts[0] == "" and cuts == sorted(set(cuts)) and len(cuts) > 8
    assert terms.route_prefixes([], 16) == [""]
    deep = terms.route_prefixes(["a" * 200 + f"{k:03}" for k in range(300)], 16)  # a common opening of any length is cut
    assert len(deep) > 15 and max(map(len, deep)) > 200


def brute(rows, declared):
    kept = {}
    for k, (key, layer, field, record, value, _) in enumerate(rows):
        if (layer, field) in declared and record is not None and value:
            kept[("k", key) if key is not None else ("n", k)] = (field, record, value)
    occurrences, records, totals = Counter(), defaultdict(set), defaultdict(set)
    for field, record, value in kept.values():
        totals[field].add(record)
        for word in re.findall(r"[^\W_]+", value.lower()):
            occurrences[field, word] += 1
            records[field, word].add(record)
    return {(f, w): (n, len(records[f, w]), len(totals[f])) for (f, w), n in occurrences.items()}


def test_counts_match_brute_force(spark):
    long = "lake " * 5000
    rows = [(k, "water", "class", k % 40, ["Lake", "river; lake", "", None, "Žleb-3 lake", "--"][k % 6], "x") for k in range(300)]
    rows += [(1, "water", "class", 1, "river; lake", "again")]  # delivered twice
    rows += [(None, "water", "class", 7, "pond pond", "no key"), (900, "water", "class", None, "nobody", ""), (901, "water", "depth", 3, "9", ""), (902, None, None, 3, "x", "")]
    rows += [(1000, "water", "class", 999, long, "")] + [(2000 + k, "water", "name", 5, "hot", "") for k in range(200)]
    declared = {("water", "class"), ("water", "name")}
    values = spark.createDataFrame(rows, SCHEMA)
    decl = spark.createDataFrame(list(declared), "layer string, field string")
    for trie_terms in (1, 10_000):
        got = terms.term_counts(values, decl, trie_terms=trie_terms)
        assert {(r["field"], r["term"]): (r["occurrences"], r["records"], r["field_records"]) for r in got.collect()} == brute(rows, declared)


def test_hot_records_and_frames_cut_anywhere(spark):
    """One record holds most rows and is spread over workers; small Arrow batches cut its runs."""
    rows = [(k, "water", "class", 1, f"lake w{k % 7}", "") for k in range(3000)] + [(None, "water", "class", 1, "lake lake", "")] * 5
    rows += [(5000 + k, "water", "class", k // 3, f"river w{k % 11}", "") for k in range(600)]
    rows += rows[:500]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for trie_terms in (3, 10_000):
            got = terms.term_counts(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("water", "class")], "layer string, field string"), trie_terms=trie_terms)
            assert {(r["field"], r["term"]): (r["occurrences"], r["records"], r["field_records"]) for r in got.collect()} == brute(rows, {("water", "class")})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_verdicts_and_empty_table(spark):
    counts = spark.createDataFrame([("f", "a", 9, 2, 10), ("f", "b", 9, 3, 100), ("f", "c", 9, 11, 100), ("f", "d", 9, 10, 100)], "field string, term string, occurrences bigint, records bigint, field_records bigint")
    assert {r["term"]: r["verdict"] for r in terms.marked(counts).collect()} == {"a": "rare", "b": "useful", "c": "common", "d": "useful"}
    empty = terms.term_counts(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", "b")], "layer string, field string"))
    assert empty.count() == 0
