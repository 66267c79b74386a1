"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most `most_copies` times its size; what is above goes to the others
by weight. With f = target / size, every document gets floor(f) certain copies. One more copy goes to a sample drawn with
inclusion probability r = f - floor(f): documents are ranked by the odds of a random number (of their id and text, so reruns
agree) divided by the odds of r, and the first whose words fit the rest of the target are taken. As documents are whole and
differ in size, what the first that doesn't fit leaves open is offered to the later documents in the same order, again and again
until none of them fits (or, where a contract says so, a stated number of times), and at last to the document nearest in size.
An offer leaves less than the first that doesn't fit has words; as the order is random, about as many offers are made as the number of words of a large document has bits.

Defined cases: null text has size 0; a null source is a source of its own, after all others; rows that agree in id, text and
source are drawn together; a source without words gets target 0; an empty table gives an empty result; very long texts count whole; other
columns are ignored (`mixture` carries them along, whatever their names).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import stored, unused, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Rows of a source that one range of the ranking holds on average.
RANGE_ROWS = 20_000


def source_key(source: Column) -> Column:
    """Not null, in code point order, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def row_key(doc_id: Column, text: Column, source: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), source_key(source), F.md5(F.coalesce(text, F.lit("")))))


def uniform(key: Column) -> Column:
    """A number above 0 and below 1 from a key's first 52 bits."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_copies: int = 3) -> DataFrame:
    """source_key, source_size, target of (source_key, source_size): one row a source. With sources ordered by cap over weight, those whose cap is below their share of what is left are a prefix, found by running sums."""
    order = W.orderBy("source_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    one = W.partitionBy(F.lit(1))
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_copies)
    out = out.withColumn("level", (F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    out = out.withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    out = out.withColumn("fill", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source_key"), F.col("level")))).over(one)["level"])
    return out.select("source_key", "source_size", F.when(F.col("open"), F.col("fill") * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"))


def _running(rows: DataFrame) -> DataFrame:
    """rows with `words_through`, the running words of a source in the ranking: sums of ranges first, so that a hot source is many tasks."""
    totals = rows.groupBy("source_key", "part").agg(F.sum("words").alias("part_words"))
    before = W.partitionBy("source_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("source_key", "part", F.coalesce(F.sum("part_words").over(before), F.lit(0)).alias("start"))
    running = W.partitionBy("source_key", "part").orderBy("rank_odds", "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("within", F.sum("words").over(running)).join(starts, ["source_key", "part"]).withColumn("words_through", F.col("start") + F.col("within")).drop("start", "within")


def draw(units: DataFrame, shares: DataFrame, name: str = "mix", offers: int | None = None) -> DataFrame:
    """units (key, source_key, size, copies, ...) with source_size, target and `times`, the copies that the mix takes of each.

    offers: how often what is left is offered down the ranking; None: until no document fits. shares has one row a source; Spark broadcasts it only below its own threshold.
    """
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = units.join(shares, "source_key").withColumn("f", f).withColumn("whole", F.floor("f").cast("long")).withColumn("chance", F.col("f") - F.col("whole"))
    u = uniform(F.col("key"))
    odds = F.when(F.col("chance") > 0, (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance"))))
    rows = rows.withColumn("u", u).withColumn("rank_odds", odds).withColumn("words", F.col("size") * F.col("copies"))
    parts = max(64, 1 << (rows.count() // RANGE_ROWS).bit_length())
    rows = stored(rows.withColumn("part", F.floor(F.col("u") * parts).cast("int")), f"{name}-ranked")
    left = rows.groupBy("source_key").agg((F.first("target") - F.first("whole") * F.first("source_size")).alias("need"))
    left = stored(left, f"{name}-need")
    pool, taken = rows.where("rank_odds is not null and words > 0").select("key", "source_key", "words", "rank_odds", "part"), None
    for offer in count() if offers is None else range(offers):
        seen = stored(_running(pool.join(left, "source_key").where("words <= need")), f"{name}-offer{offer}")
        if offers is None and seen.isEmpty():
            taken = seen.select("key") if taken is None else taken
            break
        got = seen.where("words_through <= need")
        spent = got.groupBy("source_key").agg(F.sum("words").alias("spent"))
        left = stored(left.join(spent, "source_key", "left").select("source_key", (F.col("need") - F.coalesce("spent", F.lit(0))).alias("need")), f"{name}-need")
        taken = got.select("key") if taken is None else taken.unionByName(got.select("key"))
        pool = seen.where("words_through > need").select("key", "source_key", "words", "rank_odds", "part")
    miss = F.abs(F.col("words") - F.col("need"))
    last = rows.where("rank_odds is not null and words > 0").join(taken, "key", "left_anti").join(left, "source_key").where(miss < F.col("need"))
    taken = stored(taken.unionByName(last.groupBy("source_key").agg(F.min(F.struct(miss.alias("miss"), "rank_odds", "key")).alias("best")).select("best.key")), f"{name}-taken")
    return rows.join(taken.withColumn("more", F.lit(1)), "key", "left").withColumn("times", F.col("whole") + F.coalesce("more", F.lit(0)))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", name: str = "mix") -> DataFrame:
    """One row for rows that agree in id, text and source: key, doc_id, source_key, size, copies; in the shared folder."""
    rows = docs.select(row_key(F.col(id_col), F.col(text_col), F.col(source_col)).alias("key"), F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("source_key"), word_count(F.col(text_col)).alias("size"))
    return stored(rows.groupBy("key", "doc_id", "source_key", "size").agg(F.count("*").alias("copies")), f"{name}-units")


def drawn(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_copies: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", offers: int | None = None) -> DataFrame:
    """One row for rows that agree in id, text and source: key, doc_id, size, copies, source_size, target, times."""
    own = units(docs, id_col, text_col, source_col)
    sizes = own.groupBy("source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    shares = stored(targets(sizes, weights, most_copies), "mix-targets")
    return draw(own, shares, offers=offers)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_copies: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", offers: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, times, taken."""
    rows = drawn(docs, weights, most_copies, id_col, text_col, source_col, offers)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_copies: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it."""
    rows = drawn(docs, weights, most_copies, id_col, text_col, source_col)
    own_key, own_times, copy = unused(docs, 3)
    times = stored(rows.where("times > 0").select(F.col("key").alias(own_key), F.col("times").alias(own_times)), "mix-times")
    keyed = docs.withColumn(own_key, row_key(F.col(id_col), F.col(text_col), F.col(source_col)))
    out = keyed.join(times, own_key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own_times).cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
