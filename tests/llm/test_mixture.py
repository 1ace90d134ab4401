import random

from terrane.llm import mixture

SIZED = "doc_id bigint, source string, digest string, chars bigint, n_tokens bigint"
TARGETS = "source string, target_share double, max_repeats int, note string"


def table(spark, rows):
    return spark.createDataFrame(rows, SIZED)


def test_shares_are_met_and_repeats_capped(spark):
    rng = random.Random(5)
    rows = [(k, "big" if k % 3 else "small", f"d{k}", 400, rng.randint(50, 150)) for k in range(900)]
    targets = spark.createDataFrame([("big", 0.5, 1, ""), ("small", 0.3, 2, ""), ("absent", 0.2, 4, "")], TARGETS)
    for slices in (1, 64):
        drawn, plan = mixture.mixture(table(spark, rows), targets, slices=slices)
        report = {r["source"]: r for r in mixture.share_report(drawn, plan).collect()}
        drawn = drawn.collect()
        assert abs(report["big"]["actual_share"] - 0.625) < 0.002 and abs(report["small"]["actual_share"] - 0.375) < 0.002
        assert report["absent"]["actual_share"] == 0
        cap = {"big": 1, "small": 2}
        assert all(1 <= r["copies"] <= cap[r["source"]] for r in drawn)
        # a full epoch comes before anything is drawn once more
        for source in cap:
            copies = {r["copies"] for r in drawn if r["source"] == source}
            assert max(copies) - min(copies) <= 1
            if max(copies) == 2:
                assert sum(r["source"] == source for r in drawn) == sum(x[1] == source for x in rows)


def test_slices_do_not_change_the_draw(spark):
    rows = [(k, "s", f"d{k}", 100 + k % 200, 40 + k % 17) for k in range(500)]
    targets = spark.createDataFrame([("s", 1.0, 3, "")], TARGETS)
    one = {tuple(r) for r in mixture.mixture(table(spark, rows), targets, total_tokens=9000, slices=1)[0].collect()}
    many = {tuple(r) for r in mixture.mixture(table(spark, rows), targets, total_tokens=9000, slices=512)[0].collect()}
    assert one == many and abs(sum(r[2] * r[3] for r in one) - 9000) <= 30


def test_quality_weights_favour_prose(spark):
    rows = [(k, "s", f"d{k}", 400 if k % 2 else 110, 100) for k in range(2000)]
    drawn = mixture.mixture(table(spark, rows), spark.createDataFrame([("s", 1.0, 1, "")], TARGETS), total_tokens=40_000)[0].collect()
    good = sum(r["doc_id"] % 2 for r in drawn)
    assert good > 0.85 * len(drawn)


def test_equal_texts_are_one_text(spark):
    rows = [(1, "a", "same", 40, 10), (2, "b", "same", 40, 10), (3, "a", "same", 40, 10), (4, "b", "other", 40, 10)]
    targets = spark.createDataFrame([("a", 0.5, 1, ""), ("b", 0.5, 1, "")], TARGETS)
    drawn = mixture.mixture(table(spark, rows), targets)[0].collect()
    assert sorted((r["doc_id"], r["copies"]) for r in drawn) == [(1, 1), (4, 1)]


def test_a_text_stays_with_the_targets_that_hold_it(spark):
    """Copies in a source without a target, with a share of nothing or that may not be drawn from take no text away."""
    rows = [(k, source, f"d{k}", 40, 10) for k, source in enumerate(["none", "zero", "never", "none"])] + [(10 + k, "a", f"d{k}", 40, 10) for k in range(4)] + [(20, "b", "d0", 40, 10), (21, "b", "own", 40, 10)]
    targets = spark.createDataFrame([("a", 0.8, 1, ""), ("b", 0.2, 1, ""), ("zero", 0.0, 1, ""), ("never", 0.5, 0, "")], TARGETS)
    drawn, plan = mixture.mixture(table(spark, rows), targets)
    assert sorted(r["doc_id"] for r in drawn.collect()) == [10, 11, 12, 13, 21]
    assert {r["source"]: r["available_tokens"] for r in plan.collect()} == {"a": 40, "b": 10, "never": 0}


def test_dirty_rows_and_empty_tables(spark):
    rows = [(1, None, "x", 40, 10), (2, "a", "y", 0, 0), (3, "b", "z", 40, 10), (4, "c", "w", 40, 10)]
    targets = spark.createDataFrame([("a", 0.5, 1, ""), ("b", 0.5, None, ""), ("c", -1.0, 1, ""), (None, 0.1, 1, ""), ("b", 0.4, 9, "")], TARGETS)
    drawn, plan = mixture.mixture(table(spark, rows), targets)
    assert [(r["doc_id"], r["copies"]) for r in drawn.collect()] == [(3, 1)]
    drawn, plan = mixture.mixture(table(spark, []), targets)
    assert drawn.count() == 0 and mixture.share_report(drawn, plan).count() == 2
