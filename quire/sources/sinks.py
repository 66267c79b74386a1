"""Sinks of rows: novel records, link lists, failures, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.landed import read_or_empty


def write_novels(novels: DataFrame, path: str) -> None:
    """One JSON document a row; overwrites."""
    novels.write.mode("overwrite").json(path)


def novel_json(*fields: str) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def link_json(links: DataFrame, key: str) -> DataFrame:
    """(key, value): each key's links in order, as a JSON array."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"])
    return links.groupBy(key).agg(F.to_json(ordered).alias("value"))


def write_links(links: DataFrame, key: str, path: str) -> None:
    link_json(links, key).select("value").write.mode("overwrite").text(path)


def log_line() -> Column:
    return F.concat_ws(" ", F.lit("Error at"), F.col("stage"), F.col("index").cast("string"), F.col("url"), F.col("error"))


def append_log(failures: DataFrame, path: str) -> None:
    """A line for each failure."""
    failures.select(log_line().alias("value")).write.mode("append").text(path)


def append_failures(failures: DataFrame, path: str) -> None:
    failures.write.mode("append").json(path)


def dead_letters(failures: DataFrame, key: str = "novel_id") -> DataFrame:
    """Each key's failures as one nested record, in order of index."""
    return failures.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "url", "title"))).alias("chapters"))


def read_dead_letters(spark, path: str, schema: str) -> DataFrame:
    return dead_letters(read_or_empty(spark, path, schema))


def report(*, title: Column, author: Column, chapters: Column, description: Column, genres: Column, url: Column) -> Column:
    """A record as lines to be shown."""
    lines = [
        F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Author: "), F.coalesce(author, F.lit("Unknown"))),
        F.concat(F.lit("Number of Chapters: "), chapters.cast("string")),
        F.concat(F.lit("Description: "), F.coalesce(description, F.lit("No description available"))),
        F.concat(F.lit("Genres: "), F.when(F.coalesce(F.size(genres), F.lit(0)) > 0, F.array_join(genres, ", ")).otherwise(F.lit("No genres available"))),
        F.concat(F.lit("Novel URL: "), F.coalesce(url, F.lit(""))),
    ]
    return F.concat_ws("\n", *lines)
