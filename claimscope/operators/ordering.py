"""Deduplication, ranks and top-k with explicit order of nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Ties should be broken by the order; null keys form one group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest(df: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """The values of the latest row of each key, by one partial aggregation instead of a sort. Ties on time go to the
    greatest values; rows without a time come last."""
    best = F.max(F.struct(F.col(at), *[F.col(c) for c in columns])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [at, *columns]])


def mode_with_nulls(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value of each key; a null counts as a value; ties go to the smallest, null last. Two
    aggregations, both combined before their shuffle."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.struct(-F.col("_n"), F.col(value).isNull(), F.col(value))
    return counts.groupBy(*keys).agg(F.min(rank).alias("_m")).select(*keys, F.col(f"_m.{value}").alias(name))


def keep_newest(df: DataFrame, keys: list[str], at: str, tie: str, limit: Column) -> DataFrame:
    """df with `ignored`: true beyond the newest `limit` rows of a key."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last())
    return df.withColumn("ignored", F.row_number().over(w) > limit)


def unordered(df: DataFrame, a: Column, b: Column, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each unordered pair of two comparable columns within keys."""
    pairs = df.withColumns({"_a": F.least(a, b), "_b": F.greatest(a, b)})
    return distinct_on(pairs, [*keys, "_a", "_b"], order).drop("_a", "_b")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows: every task keeps n, nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)
