"""Annotations as a stream: idempotent ingestion, completion of units, staged batches, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, key: str = "assignment_id", at: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each assignment once, however often it is delivered; with an event time the state is dropped after `delay`."""
    if at is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def completed_units(stream: DataFrame, unit: str, wanted: int) -> DataFrame:
    """(unit, n): emitted once, in the batch in which the unit's assignments reach the wanted number. State per unit
    is one count."""

    def count(key, batches, state):
        before = state.get[0] if state.exists else 0
        now = before + sum(len(b) for b in batches)
        state.update((now,))
        if before < wanted <= now:
            yield pd.DataFrame({unit: [key[0]], "n": [now]})

    kind = dict(stream.dtypes)[unit]
    return stream.groupBy(unit).applyInPandasWithState(count, f"{unit} {kind}, n long", "n long", "append", "NoTimeout")


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts per window of event time; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def staged(stages: list[tuple[str, str, Callable[[DataFrame], DataFrame]]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that moves rows through states: each stage is (from state, to state, action); the action
    gets the rows in its state and returns them, perhaps fewer. Rows in no known state stay as they are."""
    def run(batch: DataFrame, epoch: int) -> None:
        rows = batch
        for before, after, action in stages:
            moved = action(rows.filter(F.col("state") == before)).withColumn("state", F.lit(after))
            rows = rows.filter(F.coalesce(F.col("state"), F.lit("")) != before).unionByName(moved)
        run.result = rows

    run.result = None
    return run
