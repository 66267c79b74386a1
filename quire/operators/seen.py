"""What is stored already: a Bloom filter that lets most new rows pass without a shuffle, and a store that is rewritten only where fresh keys fall."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.names import unused
from quire.sources.landed import read_or_empty
from quire.sources.shared import written

#: Bits that a key sets in its word of 64, and words of a filter that is broadcast at most (some 40 MB).
MARKS, MOST_WORDS = 4, 1_000_000
FAR = 20  # keys of a word that the error rate is summed over, beyond the mean


def error_rate(keys_per_word: float, marks: int = MARKS) -> float:
    """How likely a filter takes an absent key for a stored one: keys fall on words as a Poisson variable."""
    total, p = 0.0, math.exp(-keys_per_word)
    for n in range(int(keys_per_word + FAR * math.sqrt(keys_per_word + 1)) + 1):
        total += p * (1 - (1 - 1 / 64) ** (n * marks)) ** marks
        p *= keys_per_word / (n + 1)
    return total


def words_for(keys: int, error: float) -> int:
    """Words that hold so many keys at the error rate."""
    low, high = 1e-3, 64.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if error_rate(middle) <= error else (low, middle)
    return max(1, math.ceil(keys / low))


def _word(keys: Sequence[str], words: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(words).cast("long"))


def _mask(keys: Sequence[str]) -> Column:
    spots = F.xxhash64(F.lit("spots"), *keys)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spots, 6 * k).bitwiseAND(63).cast("int")) for k in range(MARKS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom(stored: DataFrame, keys: Sequence[str], words: int) -> DataFrame:
    """(word, bits): the filter of the keys as an aggregate, which combines before it shuffles."""
    return stored.groupBy(_word(keys, words).alias("word")).agg(F.bit_or(_mask(keys)).alias("bits"))


def maybe(rows: DataFrame, filter_: DataFrame, keys: Sequence[str], words: int, name: str) -> DataFrame:
    """rows with whether the filter may hold their key; a key with a null is never stored."""
    word, bits = unused([*rows.columns, name], 2)
    known = filter_.select(F.col("word").alias(word), F.col("bits").alias(bits))
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    hit = whole & F.coalesce(F.col(bits).bitwiseAND(_mask(keys)) == _mask(keys), F.lit(False))
    return rows.withColumn(word, _word(keys, words)).join(F.broadcast(known), word, "left").withColumn(name, hit).drop(word, bits)


def missing(wanted: DataFrame, stored: DataFrame, keys: Sequence[str], error: float = 0.01, most_words: int = MOST_WORDS) -> DataFrame:
    """What is wanted and not stored, as an anti-join gives it.

    Rows that the filter refuses are new for certain and pass where they are; the others, the stored ones and `error` of the new,
    are joined. A store of so many keys that its filter would have over `most_words` words is joined plainly.
    """
    own = stored.select(*keys).dropna()
    words = words_for(own.select(F.approx_count_distinct(F.struct(*keys))).first()[0], error)
    if words > most_words:
        return wanted.join(own.distinct(), list(keys), "left_anti")
    name = unused(wanted.columns, 1)[0]
    marked = maybe(wanted, written(bloom(own, keys, words), "bloom"), keys, words, name)
    new = marked.where(~F.col(name)).drop(name)
    return new.unionByName(marked.where(name).drop(name).join(own.distinct(), list(keys), "left_anti"))


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets).cast("long")).cast("int")


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a store, without its bucket column."""
    return read_or_empty(spark, path, f"{schema}, bucket int", "parquet").drop("bucket")


def upsert_into(fresh: DataFrame, path: str, keys: Sequence[str], schema: str, buckets: int = 64) -> None:
    """Puts fresh rows in a store partitioned by a hash of the key, in place of the stored rows with their keys.

    Only buckets in which fresh keys fall are read and written again; the files of others aren't touched. schema: the store's
    columns, of which fresh may lack some. A store keeps the number of buckets that it began with. Rows that share a key all stay.
    """
    spark = fresh.sparkSession
    own = written(fresh.withColumn("bucket", _bucket(keys, buckets)), "fresh")
    touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    stored = read_or_empty(spark, path, f"{schema}, bucket int", "parquet").where(F.col("bucket").isin(touched))
    same = reduce(and_, [stored[k].eqNullSafe(own[k]) for k in keys])
    merged = own.unionByName(stored.join(own.select(*keys).distinct(), same, "left_anti"), allowMissingColumns=True)
    columns = [c for c in stored.columns if c != "bucket"]
    merged.select(*columns, "bucket").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
