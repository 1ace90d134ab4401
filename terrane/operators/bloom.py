"""A Bloom filter built, broadcast and probed by built-in expressions.

Every key sets four bits of one 64-bit word, so a probe reads one array element, and there is a word for every four keys, at which one
absent key in 150 passes, whatever the number of keys: up to ``MAX_WORDS`` words the filter is one broadcast row; beyond that it is divided by a
hash of the key into shards of ``SHARD_WORDS`` words, one row each, that meet the probing rows by a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**20 words are 8 MB, the most that is ever broadcast.
MAX_WORDS = 1 << 20
#: 2**17 words are 1 MB, the size of a shard.
SHARD_WORDS = 1 << 17
KEYS_PER_WORD = 4


def words_for(keys: int) -> int:
    """A power of two of words for an upper estimate of the keys."""
    wanted = 1 << 8
    while wanted * KEYS_PER_WORD < keys:
        wanted *= 2
    return wanted


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(17))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def build(keys: DataFrame, key: str, words: int) -> DataFrame:
    """One row with the filter's words as an array; partial words are combined map-side."""
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    own = keys.filter(F.col(key).isNotNull()).select(_word(F.col(key), words).alias("word"), _mask(F.col(key)).alias("mask"))
    merged = own.groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).unionByName(every).groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "mask")))
    return merged.agg(F.transform(ordered, lambda x: x["mask"]).alias("words"))


def may_contain(key: Column, words_column: Column, words: int) -> Column:
    """False only for keys that are surely not in the filter."""
    mask = _mask(key)
    return F.get(words_column, _word(key, words)).bitwiseAND(mask) == mask


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(29)), F.lit(shards)).cast("int")


def build_shards(keys: DataFrame, key: str, shards: int, words: int) -> DataFrame:
    """(shard, words) of every shard; partial words are combined map-side."""
    own = keys.filter(F.col(key).isNotNull()).select(_shard(F.col(key), shards).alias("shard"), _word(F.col(key), words).alias("word"), _mask(F.col(key)).alias("mask"))
    merged = own.groupBy("shard", "word").agg(F.expr("bit_or(mask)").alias("mask"))
    every = keys.sparkSession.range(shards * words).select(F.floor(F.col("id") / words).cast("int").alias("shard"), (F.col("id") % words).cast("int").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    filled = merged.unionByName(every).groupBy("shard", "word").agg(F.expr("bit_or(mask)").alias("mask"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "mask")))
    return filled.groupBy("shard").agg(F.transform(ordered, lambda x: x["mask"]).alias("words"))


def marked(rows: DataFrame, column: str, keys: DataFrame, key: str, n_keys: int, max_words: int = MAX_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``rows`` with ``maybe``, which is false only where ``column`` is surely none of ``keys``; ``n_keys`` is an upper estimate of these."""
    words = words_for(n_keys)
    if words <= max_words:
        return rows.withColumn("maybe", may_contain(F.col(column), build(keys, key, words).scalar(), words))
    shards = -(-words // shard_words)
    joined = rows.withColumn("_shard", _shard(F.col(column), shards)).join(build_shards(keys, key, shards, shard_words).withColumnsRenamed({"shard": "_shard", "words": "_words"}), "_shard", "left")
    return joined.withColumn("maybe", F.coalesce(may_contain(F.col(column), F.col("_words"), shard_words), F.lit(False))).drop("_shard", "_words")
