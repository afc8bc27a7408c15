"""States of submissions, questions, units of work and assignments: vocabularies and audits of transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Allowed states.
STATES = {
    "question": ("pending-turking", "pending-annotation", "pending-extraction", "done", "error", "revoked", "deleted"),
    "assignment": ("pending-extraction", "pending-validation", "pending-payment", "done", "error", "rejected", "approved"),
}


def unknown_states(df: DataFrame, kind: str, state: str = "state") -> DataFrame:
    """Rows whose state the vocabulary lacks; a null state is unknown too."""
    return df.filter(F.col(state).isNull() | ~F.col(state).isin(*STATES[kind]))


def revoked(questions: DataFrame, batch_ids: DataFrame) -> DataFrame:
    """questions with those of the given batches (batch_id) revoked, unless they ended in an error."""
    hit = batch_ids.select("batch_id").distinct().withColumn("_hit", F.lit(True))
    j = questions.join(hit, "batch_id", "left")
    return j.withColumn("state", F.when(F.col("_hit") & (F.col("state") != "error"), "revoked").otherwise(F.col("state"))).drop("_hit")
