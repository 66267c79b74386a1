"""Rows by the longest of many prefixes that a text begins with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.names import unused
from quire.sources.shared import written

#: Prefixes that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 500_000


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str = "prefix", name: str = "prefix") -> DataFrame:
    """rows with the longest of the prefixes that the text begins with, null where there is none.

    A text is looked up by its beginnings of the lengths that prefixes have, each by equality, so the plan's size and a text's lookups
    depend on the lengths alone, and not on how many prefixes there are. Each different text is looked up once. Null texts and prefixes match
    nothing, an empty prefix everything.
    """
    table = written(prefixes.where(F.col(prefix).isNotNull()).select(F.col(prefix).alias("own")).distinct(), "prefixes")
    lengths = sorted(r[0] for r in table.select(F.length("own")).distinct().collect())  # the different lengths, not the prefixes
    n = table.count()
    if not n:
        return rows.withColumn(name, F.lit(None).cast("string"))
    texts = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("whole")).distinct()
    starts = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k <= F.length("whole"))
    begun = texts.select("whole", F.explode(F.transform(starts, lambda k: F.col("whole").substr(F.lit(1), k))).alias("own"))
    found = begun.join(F.broadcast(table) if n <= MOST_BROADCAST else table, "own").groupBy("whole").agg(F.max_by("own", F.length("own")).alias("own"))
    key, value = unused([*rows.columns, name], 2)
    out = rows.join(found.select(F.col("whole").alias(key), F.col("own").alias(value)), F.col(text) == F.col(key), "left").drop(key)
    return out.withColumn(name, F.col(value)).drop(value)


def not_blocked(rows: DataFrame, url: str, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """rows whose URL begins with none of the prefixes."""
    name = unused(rows.columns, 1)[0]
    return longest_prefix(rows, url, prefixes, prefix, name).where(F.col(name).isNull()).drop(name)
