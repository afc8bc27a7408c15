"""References whose parent record is missing, deleted or only came later.

All references of all tables and all parent keys go through one sort-merge join: both sides are
hash-partitioned by (parent table, key), sorted, and merged in one linear pass. Parents are reduced to one validity
interval per key before that, so no key multiplies rows. The intervals are written to the shared folder: both sides then
enter the join through an exchange of their own, which is what lets adaptive execution split a key that holds a
large part of the references (skew join on the left side of the outer join).

Defined results: a null reference (any part null) is no case. A null time on either side can't show lateness, so
such a reference fails only if its parent is missing or deleted; its period is null where the child's time is.
Repeated rows count once. Keys compare exactly as stored. Empty tables give no rows (an empty parent table makes
every reference missing).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.session import written


@dataclass(frozen=True)
class Reference:
    """child.key -> parent.key; the columns are expressions on their own table."""

    child_table: str
    child: DataFrame
    record_key: Column
    key: Column
    at: Column
    parent_table: str


@dataclass(frozen=True)
class Parent:
    """Parent keys with the time from which each is valid; deleted: true where the record is gone."""

    table: str
    rows: DataFrame
    key: Column
    since: Column
    deleted: Column | None = None


def joined_key(*parts: Column) -> Column:
    """Parts joined by '|', null if any part is null."""
    text = [p.cast("string") for p in parts]
    return reduce(lambda a, b: F.concat(a, F.lit("|"), b), text) if len(text) > 1 else text[0]


def validity(parents: list[Parent]) -> DataFrame:
    """(parent_table, key, since, deleted): one row per key. Deleted holds where every stored row of the key is deleted."""
    each = [
        p.rows.select(
            F.lit(p.table).alias("parent_table"), p.key.cast("string").alias("key"), p.since.alias("since"),
            F.coalesce(p.deleted if p.deleted is not None else F.lit(False), F.lit(False)).alias("deleted"),
        ).filter(F.col("key").isNotNull())
        for p in parents
    ]
    return reduce(DataFrame.unionByName, each).groupBy("parent_table", "key").agg(F.min("since").alias("since"), F.bool_and("deleted").alias("deleted"))


def orphans(references: list[Reference], parents: list[Parent]) -> DataFrame:
    """(child_table, record_key, missing_key, period, kind), one row per failing record."""
    refs = reduce(
        DataFrame.unionByName,
        [
            r.child.select(F.lit(r.child_table).alias("child_table"), r.record_key.alias("record_key"), r.key.cast("string").alias("key"), r.at.alias("at"), F.lit(r.parent_table).alias("parent_table"))
            .filter(F.col("key").isNotNull())
            for r in references
        ],
    )
    intervals = written(validity(parents), "validity").withColumn("found", F.lit(True))
    merged = refs.join(intervals.hint("merge"), ["parent_table", "key"], "left")
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("since") > F.col("at"), "late")
    # the failing rows, which are few, are made distinct through an exchange of their own: one that reused the key's
    # partitioning would keep a hot key together. concat hides from the planner that the key is the same.
    return (
        merged.select("child_table", "record_key", F.concat("key", F.lit("")).alias("missing_key"), F.date_format("at", "yyyy-MM").alias("period"), kind.alias("kind"))
        .filter(F.col("kind").isNotNull())
        .distinct()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Failing references per table and period."""
    return found.groupBy("child_table", "period", "kind").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("missing_key").alias("n_keys"))
