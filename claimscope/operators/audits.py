"""Constraints as queries: keys, references, checks, states, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_parents(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows with complete keys that no parent has."""
    return child.dropna(subset=keys).join(parent.select(*keys), keys, "left_anti")


def violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows whose check is false (null passes, as CHECK constraints have it)."""
    return df.filter(~check)


def unnormalised(df: DataFrame, keys: list[str], p: str, eps: float = 1e-6) -> DataFrame:
    """Keys whose probabilities don't sum to one."""
    return df.groupBy(*keys).agg(F.sum(p).alias("total")).filter(F.abs(F.col("total") - 1) > eps)
