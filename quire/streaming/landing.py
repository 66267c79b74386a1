"""Landed pages as a stream: a page is appended when its key comes for the first time, whatever the runs before.

What has come is keyed state of the stream (RocksDB), partitioned like the keys, so a micro-batch reads nothing of the store, and its
cost is that of its own pages. The state, the place in the input and the store's files are committed together: a run
that ends early is taken up by the next one with nothing lost and nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.elements import parse

PAGE = "page_id bigint, url string, html string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_pages(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", most_files).parquet(path)


def read_keys(spark: SparkSession, path: str, key: str = "url") -> DataFrame:
    """The keys of pages that another job has stored; only files that are new since the last run are read, and of them the key alone."""
    return spark.readStream.schema(PAGE).parquet(path).select(key)


def _first_come(order: str):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, best = state.exists, None
        for frame in frames:  # a key's pages of one batch, some at a time
            known = known or bool(frame["stored"].any())
            if not known:
                least = frame.nsmallest(1, order)
                if best is None or least[order].iloc[0] < best[order].iloc[0]:
                    best = least
        if not state.exists:
            state.update((True,))
        if not known and best is not None:
            yield best.drop(columns="stored")

    return run


def new_pages(pages: DataFrame, key: str = "url", order: str = "page_id", stored: DataFrame | None = None) -> DataFrame:
    """Of a stream of pages those whose key is new: of a batch's pages with one key the least by `order`. A null key is a key.

    stored: a stream of keys (column `key`) that count as having come.
    """
    marked = pages.withColumn("stored", F.lit(False))
    if stored is not None:
        marked = marked.unionByName(stored.select(key).withColumn("stored", F.lit(True)), allowMissingColumns=True)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return marked.groupBy(key).applyInPandasWithState(_first_come(order), schema, "come boolean", "append", GroupStateTimeout.NoTimeout)


def append_new(pages: DataFrame, path: str, checkpoint: str, key: str = "url", stored: DataFrame | None = None) -> StreamingQuery:
    """Parses and appends the pages whose key is new. Runs until the landed files are used up."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    fresh = parse(new_pages(pages, key, "page_id", stored).select("page_id", "url", "html"))
    out = fresh.selectExpr("page_id", "url", "transform(elements, e -> e.tag) as elements")
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
