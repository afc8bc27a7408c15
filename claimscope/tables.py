"""Access to the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table; filters and projections put on it reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
