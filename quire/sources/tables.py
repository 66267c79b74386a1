"""Scans of landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.session import ship


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
