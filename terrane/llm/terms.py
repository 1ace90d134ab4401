"""Problem 4: how often every term occurs, in how many records, and which terms are too rare or too common.

Method: burst-trie counting. Rows are shuffled once, by (field, record), and sorted, so that the copies of a row and all values of a record
lie side by side. Each worker cuts the values into terms, routes every term by its prefix to one of its compact burst tries, one per
(field, route), and counts there: a term's node adds up occurrences, and records by remembering the record that it saw last. Routes
are prefixes that adapt to a bounded sample of terms, one per ``ROUTE_TERMS`` sampled terms: frequent openings get longer prefixes, as long as
it takes. Full tries are flushed as subtrees; matching subtrees of all workers meet by (field, route) and are merged. No term is grouped
before the tries.

Skew. A hot term or field shrinks in the tries before anything else is shuffled. A record that the sample shows to be hot is spread by row key
over many workers; its terms go to tries of their own that are marked with the record, so that the merge counts it once per term
(at most ``1 / HOT_SHARE`` records are hot). The number of records per field is counted by the same tries, as the empty term; the
merged counters, one row per term, are checkpointed, so that it can be read off them.

Defined results for dirty input: rows with a null field, record or value, and empty values, count nowhere; a value without any letter
or digit makes its record count for the field but has no term; very long values are used whole; rows of equal key, field, record and value are
copies and count once; a null key makes a row that has no copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import durable
from terrane.streams import over_groups

RARE_RECORDS = 3
COMMON_SHARE = 0.1
#: At most so many sampled rows and distinct sampled terms reach the driver to choose the routes and the hot records.
SAMPLE_TERMS = 20_000
#: A route holds about so many of the sampled terms.
ROUTE_TERMS = 16
#: A record with a larger share of the sampled rows is spread over workers.
HOT_SHARE = 0.01
#: A container holds so many suffixes before it bursts.
BURST_AT = 64
#: A worker's tries are flushed at so many terms.
TRIE_TERMS = 400_000


class BurstTrie:
    """Counters [occurrences, records, last record] by term. A node is a container {suffix: counter} until it bursts into nodes by first letter."""

    __slots__ = ("root", "size", "burst_at")

    def __init__(self, burst_at: int = BURST_AT):
        self.root: list = [{}, None, None]  # container, children, counter of the term that ends here
        self.size, self.burst_at = 0, burst_at

    def add(self, term: str, occurrences: int, record: int, records: int = 1) -> None:
        """Count occurrences, and ``records`` unless ``record``, which is not 0, was the last to come by."""
        node, at = self.root, 0
        while node[1] is not None:
            if at == len(term):
                if node[2] is None:
                    node[2] = [0, 0, 0]
                    self.size += 1
                counter = node[2]
                break
            child = node[1].get(term[at])
            if child is None:
                child = node[1][term[at]] = [{}, None, None]
            node, at = child, at + 1
        else:
            held = node[0]
            counter = held.get(term[at:])
            if counter is None:
                counter = held[term[at:]] = [0, 0, 0]
                self.size += 1
                if len(held) > self.burst_at:
                    self._burst(node)
        counter[0] += occurrences
        if counter[2] != record:
            counter[1] += records
            counter[2] = record

    def _burst(self, node: list) -> None:
        node[1], held = {}, node[0]
        node[0] = None
        for suffix, counter in held.items():
            if not suffix:
                node[2] = counter
                continue
            child = node[1].get(suffix[0])
            if child is None:
                child = node[1][suffix[0]] = [{}, None, None]
            child[0][suffix[1:]] = counter
        for child in node[1].values():
            if len(child[0]) > self.burst_at:
                self._burst(child)

    def items(self) -> Iterator[tuple[str, int, int]]:
        """All terms in order of their letters."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if node[1] is None:
                for suffix in sorted(node[0]):
                    yield prefix + suffix, *node[0][suffix][:2]
            else:
                if node[2] is not None:
                    yield prefix, *node[2][:2]
                for letter in sorted(node[1], reverse=True):
                    stack.append((prefix + letter, node[1][letter]))


def route_prefixes(sample: list[str], route_terms: int = ROUTE_TERMS) -> list[str]:
    """Sorted prefixes that open ranges of terms; openings with more than ``route_terms`` sampled terms are cut at longer prefixes. The first is empty."""
    opened, todo = {""}, [("", sorted(set(sample)))]
    while todo:
        prefix, terms = todo.pop()
        if len(terms) <= route_terms:
            continue
        groups: dict[str, list[str]] = {}
        for term in terms:
            if len(term) > len(prefix):
                groups.setdefault(term[: len(prefix) + 1], []).append(term)
        run = 0
        for longer, inside in sorted(groups.items()):
            if run == 0 or run + len(inside) > route_terms:
                opened.add(longer)
                run = 0
            run += len(inside)
            if len(inside) > route_terms:
                todo.append((longer, inside))
                run = 0
    return sorted(opened)


def _terms(value):
    return F.filter(F.split(F.lower(value), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, int, list, bool]]:
    """(field, record, rows, terms, hot) of each run of equal (field, record, value) in sorted frames; rows of equal key count once."""
    held = None  # the last run may go on in the next frame
    for frame in frames:
        if not len(frame):
            continue
        field, record, value, key, terms, hot = (frame[c].to_numpy() for c in ("field", "record", "value", "key", "terms", "hot"))
        unkeyed = ~frame["keyed"].to_numpy(bool)
        opens = np.ones(len(frame), dtype=bool)
        opens[1:] = (field[1:] != field[:-1]) | (record[1:] != record[:-1]) | (value[1:] != value[:-1])
        if held is not None:
            opens[0] = (field[0], record[0], value[0]) != held[0]
        counted = opens | unkeyed
        counted[1:] |= key[1:] != key[:-1]
        counted[0] |= held is not None and (held[4] is None or key[0] != held[4])
        starts = np.flatnonzero(opens)
        amounts = np.add.reduceat(counted, np.concatenate([[0], starts[starts > 0]]), dtype=np.int64)
        if not opens[0]:
            held[1] += int(amounts[0])
            amounts = amounts[1:]
        for start, amount in zip(starts.tolist(), amounts.tolist()):
            if held is not None:
                yield *held[0][:2], *held[1:4]
            held = [(field[start], record[start], value[start]), amount, terms[start], bool(hot[start]), None]
        held[4] = None if unkeyed[-1] else key[-1]
    if held is not None:
        yield *held[0][:2], *held[1:4]


def _packed(tries: dict[tuple[str, int, int | None], BurstTrie]) -> pd.DataFrame:
    rows = [(field, route, tag, *map(list, zip(*trie.items()))) for (field, route, tag), trie in tries.items()]
    frame = pd.DataFrame(rows, columns=["field", "route", "tag", "terms", "occurrences", "records"])
    return frame.astype({"tag": "Int64"})


def term_counts(values: DataFrame, declared: DataFrame, sample_terms: int = SAMPLE_TERMS, trie_terms: int = TRIE_TERMS, rows: int | None = None) -> DataFrame:
    """(field, term, occurrences, records, field_records): every distinct term of every declared field.

    ``values`` are (key, layer, field, record, value) with whole numbers as keys and records; only rows whose (layer, field) is in ``declared`` count.
    """
    rows = values.count() if rows is None else rows
    spark = values.sparkSession
    real = values.filter("field is not null and record is not null and value is not null and value != ''").join(declared.distinct(), ["layer", "field"], "left_semi")
    picked = real.sample(fraction=min(1.0, 2 * sample_terms / max(1, rows)), seed=11).limit(sample_terms).select("field", "record", F.slice(_terms("value"), 1, 100).alias("terms")).collect()
    sampled = list(dict.fromkeys(w for r in picked for w in r["terms"]))[:sample_terms]
    often = Counter((r["field"], r["record"]) for r in picked)
    hot = [k for k, n in often.items() if n > max(20, HOT_SHARE * len(picked))]
    shared = spark.sparkContext.broadcast(route_prefixes(sampled))  # bounded by the sample

    def accumulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = shared.value
        tries: dict[tuple[str, int, int | None], BurstTrie] = {}
        serial, last, size = 0, None, 0
        for field, record, amount, terms, is_hot in runs(frames):
            if size > trie_terms and (is_hot or (field, record) != last):  # never between the values of one record
                yield _packed(tries)
                tries, size = {}, 0
            if (field, record) != last:
                serial, last = serial + 1, (field, record)
                tag = int(record) if is_hot else None
            for term in ("", *terms):
                route = bisect_right(cuts, term) - 1
                trie = tries.get((field, route, tag))
                if trie is None:
                    trie = tries[field, route, tag] = BurstTrie()
                before = trie.size
                trie.add(term, amount, serial)
                size += trie.size - before
        if tries:
            yield _packed(tries)

    def merge(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        whole = BurstTrie()
        serial = 0
        for tag, part in group.groupby("tag", dropna=False, sort=True):
            for terms, occurrences, records in zip(part["terms"], part["occurrences"], part["records"]):
                if pd.isna(tag):
                    for term, o, r in zip(terms, occurrences.tolist(), records.tolist()):
                        serial += 1
                        whole.add(term, o, -serial, r)
                else:  # one record, whose rows were on several workers
                    for term, o in zip(terms, occurrences.tolist()):
                        whole.add(term, o, ("hot", int(tag)))
        field, out = group["field"].iloc[0], []
        for row in whole.items():
            out.append((field, *row))
            if len(out) == 20_000:
                yield pd.DataFrame(out, columns=["field", "term", "occurrences", "records"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["field", "term", "occurrences", "records"])

    is_hot = F.lit(False)
    for field, record in hot:
        is_hot = is_hot | ((F.col("field") == field) & (F.col("record") == record))
    by_record = real.select(F.col("key").isNotNull().alias("keyed"), F.coalesce("key", F.lit(0)).alias("key"), "field", "record", "value", is_hot.alias("hot"))
    salted = by_record.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key", "value"), F.lit(1024)).cast("int")).otherwise(0))
    lined = salted.repartition("field", "record", "salt").sortWithinPartitions("field", "record", "value", "keyed", "key").select("keyed", "key", "field", "record", "value", "hot", _terms("value").alias("terms"))
    parts = lined.mapInPandas(accumulate, "field string, route int, tag bigint, terms array<string>, occurrences array<bigint>, records array<bigint>")
    counts = durable(over_groups(parts, ["field", "route"], merge, "field string, term string, occurrences bigint, records bigint"))
    totals = counts.filter("term = ''").select("field", F.col("records").alias("field_records"))
    return counts.filter("term != ''").join(totals, "field")


def marked(counts: DataFrame, rare: int = RARE_RECORDS, share: float = COMMON_SHARE) -> DataFrame:
    """Adds ``verdict``: rare, common or useful."""
    return counts.withColumn("verdict", F.when(F.col("records") < rare, "rare").when(F.col("records") > share * F.col("field_records"), "common").otherwise("useful"))
