"""Problem 7: a mixture of sources whose tokens come as near as possible to target shares.

Method: Efraimidis-Spirakis sampling. Each text gets the key -ln(u) / w, with u uniform from a hash of its key and w its quality
weight; texts are taken in the order of that key within their source, which is weighted sampling without replacement. A source's token
budget is first spent on complete epochs (every text once), as often as it fits and at most ``max_repeats`` times, and the rest on the
texts whose prefix sums stay within it; the text that crosses the rest is taken if that comes nearer.

The default total is the largest at which every source can meet its share; targets without any text get nothing and the others
keep their proportions. Texts that are equal to the letter count as one text, of the source of their smallest key among the sources that
may be drawn from, however many archives hold them, so no text is used more than ``max_repeats`` times.

Quality weight: characters per token, scaled to [0.05, 1]. Natural prose needs few tokens for its characters, encoded or random
matter many.

Skew. Prefix sums are made over (source, slice of the key range) groups of bounded share, with offsets from the groups' sums, so a
source that holds a third of all texts is spread over ``slices`` groups.

Defined results for dirty input: null or empty texts, sources without a target and targets that are null or not positive draw
nothing; a null or negative ``max_repeats`` counts as 1 or 0; a target source named twice keeps its largest row; equal keys are
ordered by doc_id; empty tables give an empty mixture; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.tokens import VOCABULARY, token_counts
from terrane.session import durable

SLICES = 1024


def sized_texts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, digest, n_chars, n_tokens) of every document, checkpointed: texts are read and tokenised once."""
    base = documents.select("doc_id", "source", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"), "text")
    return durable(token_counts(base, ["doc_id", "source", "digest", "chars"], vocabulary=vocabulary))


def distinct_texts(sized: DataFrame) -> DataFrame:
    """One row per text, under its smallest doc_id."""
    one = sized.filter("n_tokens > 0 and source is not null").groupBy("digest").agg(F.min_by(F.struct("doc_id", "source", "n_tokens", "chars"), "doc_id").alias("d"))
    return one.select("d.*")


def mixture(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """The drawn texts (doc_id, source, n_tokens, copies) and the plan (source, target_share, max_repeats, available_tokens, budget, epochs, rest)."""
    spark = sized.sparkSession
    goal = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.max(F.struct("target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))).alias("g")).select("source", "g.*")
    drawable = goal.filter("max_repeats > 0").select("source")  # before equal texts become one, so that no other source takes a text away
    texts = durable(distinct_texts(sized.join(drawable, "source", "left_semi")))
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.avg(_weight()).alias("mean_weight"))
    rows = goal.join(have, "source", "left").collect()  # one row per target
    live = [r for r in rows if r["available_tokens"] and r["max_repeats"] > 0]
    shares = sum(r["target_share"] for r in live)
    most = min((r["available_tokens"] * r["max_repeats"] / (r["target_share"] / shares) for r in live), default=0)
    total = most if total_tokens is None else total_tokens
    plan = []
    for r in rows:
        have_tokens, repeats = r["available_tokens"] or 0, r["max_repeats"]
        budget = min(total * r["target_share"] / shares, float(have_tokens * repeats)) if r in live else 0.0
        budget = float(have_tokens * repeats) if have_tokens and abs(budget - have_tokens * repeats) < 0.5 else budget
        epochs = int(budget // have_tokens) if have_tokens else 0
        plan.append((r["source"], r["target_share"], repeats, have_tokens, budget, epochs, budget - epochs * have_tokens, r["mean_weight"] or 1.0))
    planned = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, available_tokens bigint, budget double, epochs int, rest double, mean_weight double")
    keyed = texts.join(F.broadcast(planned.select("source", "epochs", "rest", "mean_weight")), "source").withColumn("key", _key(seed))  # one row per target
    sliced = keyed.withColumn("slice", F.floor(F.lit(slices) * (1 - F.exp(-F.col("key") * F.col("mean_weight")))).cast("int"))
    sums = sliced.groupBy("source", "slice").agg(F.sum("n_tokens").alias("s"))
    offsets = sums.select("source", "slice", (F.sum("s").over(Window.partitionBy("source").orderBy("slice")) - F.col("s")).alias("offset"))
    order = Window.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sliced.withColumn("run", F.sum("n_tokens").over(order)).join(offsets, ["source", "slice"]).withColumn("upto", F.col("offset") + F.col("run"))
    over = F.col("upto") - F.col("rest")
    taken = (over <= 0) | ((over < F.col("n_tokens")) & (over < F.col("n_tokens") - over))
    drawn = summed.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.when(taken & (F.col("rest") > 0), 1).otherwise(0)).alias("copies")).filter("copies > 0")
    return drawn, planned.drop("mean_weight")


def _weight():
    return F.least(F.greatest((F.col("chars") / F.col("n_tokens") - 1.0) / 3.0, F.lit(0.05)), F.lit(1.0))


def _key(seed: int):
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / _weight()


def share_report(drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, epochs, n_texts, drawn_tokens, actual_share) for every target."""
    got = drawn.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"))
    joined = planned.join(got, "source", "left").fillna(0, ["n_texts", "drawn_tokens"])
    total = F.sum("drawn_tokens").over(Window.partitionBy())  # one row per target
    return joined.select("source", "target_share", "max_repeats", "available_tokens", "epochs", "n_texts", "drawn_tokens", F.round(F.coalesce(F.col("drawn_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias("actual_share"))
