"""The registered queries, their SQL, and the tables that stand in for novels and attempts.

Stand-ins: a novel is a conversation and a chapter a turn (index from 1); attempts are events, of which "error" failed; stored
items are labels, fresh ones documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def long(x: Column) -> Column:
    return x.cast("long")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters: conv_id, index, role, title, text."""
    rows = read_table(spark, sf_dir, "conversations")
    return rows.select("conv_id", long(F.col("turn") + 1).alias("index"), "role", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")


def failed() -> Column:
    return F.col("event_type") == "error"


#: Chapters in SQL.
CH = "SELECT conv_id, CAST(turn + 1 AS BIGINT) AS index, role, split_part(text, chr(10), 1) AS title, text FROM conversations"
