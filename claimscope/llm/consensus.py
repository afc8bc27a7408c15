"""Consensus of several annotators' labels by iteratively reweighted voting.

Alternates a weighted vote per item with each annotator's accuracy until both are stable. The accuracy of an
annotator is measured leave-one-out: an answer counts as right if it equals the weighted vote of all *other*
annotators of the item. It is smoothed twice: the annotator's overall accuracy towards `PRIOR`, and the accuracy of
each label the annotator gives towards the overall one (some annotators confuse only certain labels). A vote weighs
log((K-1) * accuracy / (1 - accuracy)), so that annotators who are worse than chance count against their answer.

Scale: answers are reduced to one count per (item, annotator, label) before they are put into one row per item, so no
item holds more than its annotators times their labels, however often it was judged. These rows are written once.
A round is one pass over them, in Arrow batches: the votes of an item lie in its row, so that leaving one annotator out
needs no join, and only sums per (annotator, label) are shuffled. Their weights are broadcast while there are at
most `BROADCAST_CELLS` of them (counted), and joined to the answers by shuffle beyond that. The label vocabulary is
checked against `MAX_LABELS`.

Defined results: answers with a null item, annotator or label are no answers (a zero weight makes the label `NONE`
whatever its type, a null weight counts as an answer); repeated answers count once; ties go to the smaller label;
an item judged by one annotator gets that answer, with null agreement; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.session import discard, written, written_at

#: Accuracy and weight (in answers) of the prior of an annotator; weight of the overall accuracy for each label.
PRIOR, PRIOR_WEIGHT, LABEL_WEIGHT = 0.7, 2.0, 10.0
#: Accuracies are kept away from 0 and 1 by this much.
EDGE = 0.01
MAX_LABELS = 256
#: A vote that hasn't settled by then is an error; from SLOW on, steps shrink with the number of the round.
MAX_ROUNDS, SLOW = 200, 20
#: Stable: no more than this share of the leave-one-out judgements changed in a round.
STABLE = 2e-4
#: Share of the previous accuracy that stays in the next: without it items of few annotators can flip for ever.
DAMPING = 0.3
#: Weights of (annotator, label) that are broadcast, 16 bytes each; with more of them they are joined.
BROADCAST_CELLS = 4_000_000

ITEM = ["doc_id", "span_lo", "span_hi"]


def answers(responses: DataFrame) -> DataFrame:
    """(doc_id, span_lo, span_hi, worker_id, label) of evaluation_mention_response, repeats once: what tells answers
    of one annotator apart is the assignment and its time, of which a hash is enough."""
    label = F.when(F.col("weight") == 0, F.lit("NONE")).otherwise(F.col("mention_type"))
    return (
        responses.select("doc_id", F.col("span.lo").alias("span_lo"), F.col("span.hi").alias("span_hi"), "worker_id", F.xxhash64("assignment_id", "created").alias("_answer"), label.alias("label"))
        .dropna(subset=[*ITEM, "worker_id", "label"])
        .distinct()
        .drop("_answer")
    )


def labels_of(votes: DataFrame) -> list[str]:
    """The label vocabulary in order; refused beyond MAX_LABELS."""
    found = [r["label"] for r in votes.groupBy("label").count().orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return found


class _Batch:
    """The votes of a batch of items, flat. cells: sorted codes (annotator * K + label) with their weights, None if the
    rows bring their weights."""

    def __init__(self, batch: pa.RecordBatch, k: int, cells: tuple[np.ndarray, np.ndarray] | None):
        lists = batch.column("x")
        at = lists.offsets.to_numpy()
        flat = lists.flatten()
        self.k, self.items = k, len(lists)
        self.w, self.label, self.n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        self.item = np.repeat(np.arange(self.items), np.diff(at))
        self.code = self.w * k + self.label
        weight = flat.field(3).to_numpy(zero_copy_only=False) if cells is None else cells[1][np.searchsorted(cells[0], self.code)]
        self.votes = self.n * weight
        # one group per (item, annotator), whose rows lie together
        new = np.ones(len(self.w), dtype=bool)
        new[1:] = (self.w[1:] != self.w[:-1]) | (self.item[1:] != self.item[:-1])
        self.group = np.cumsum(new) - 1
        self.group_item = self.item[new]
        self.annotators = np.bincount(self.group_item, minlength=self.items)

    def table(self, rows: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
        """Sums by (row, label)."""
        return np.bincount(rows * self.k + self.label, weights=values, minlength=size * self.k).reshape(size, self.k)

    def judged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, right, judged): per (annotator, label) the answers with another annotator, and those that the others
        confirm."""
        totals = self.table(self.item, self.items, self.votes)
        own = self.table(self.group, len(self.group_item), self.votes)
        choice = np.argmax(np.round(totals[self.group_item] - own, 9), axis=1) if len(own) else np.zeros(0)
        shared = self.annotators[self.item] > 1
        codes, at = np.unique(self.code[shared], return_inverse=True)
        right = (choice[self.group] == self.label) * self.n
        return codes, np.bincount(at, weights=right[shared], minlength=len(codes)), np.bincount(at, weights=self.n[shared], minlength=len(codes))

    def results(self) -> dict[str, np.ndarray]:
        totals = self.table(self.item, self.items, self.votes)
        counts = self.table(self.item, self.items, self.n)
        own = self.table(self.group, len(self.group_item), self.n)
        size = counts.sum(1)
        of_groups = lambda x: np.bincount(self.group_item, weights=x, minlength=self.items)
        agree = (counts * counts).sum(1) - of_groups((own * own).sum(1))
        pairs = size * size - of_groups(own.sum(1) ** 2)
        positive = np.maximum(totals, 0).sum(1)
        # only labels somebody gave can win: with negative weights all sums may be negative
        best = np.argmax(np.where(counts > 0, np.round(totals, 9), -np.inf), axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return {"best": best, "n_workers": self.annotators, "n_answers": size, "agreement": agree / pairs, "no_pairs": pairs == 0, "margin": np.maximum(totals.max(1), 0) / positive, "no_margin": positive <= 0}


class Consensus:
    """Runs to stability; `items()` and `workers()` give the results."""

    def __init__(self, votes: DataFrame, item: list[str] = ITEM, broadcast_cells: int = BROADCAST_CELLS):
        self.item, self.labels = item, labels_of(votes)
        k = self.k = max(len(self.labels), 1)
        label = (F.array_position(F.array(*map(F.lit, self.labels)), F.col("label")) - 1).cast("int") if self.labels else F.lit(0)
        counts = votes.groupBy(*item, "worker_id", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
        # ids that depend on where partitions begin are written before use
        self.names = written(votes.select("worker_id").distinct().withColumn("w", F.monotonically_increasing_id()), "annotators")
        each = counts.join(self.names, "worker_id")
        row = F.sort_array(F.collect_list(F.struct("w", label.alias("l"), "n")))
        self.rows = written(each.groupBy(*item).agg(row.alias("x")), "judged")
        cells = self.rows.select(F.explode("x").alias("x")).groupBy("x.w", "x.l").agg(F.sum("x.n").alias("answers"))
        self.cells, self.rounds = written(cells, "cells"), 0
        self.small = self.cells.count() <= broadcast_cells
        self._run_here() if self.small else self._run_joined()

    # weights that fit into one array

    def _run_here(self) -> None:
        k, spark = self.k, self.rows.sparkSession
        known = self.cells.toPandas()  # at most broadcast_cells rows
        codes = known["w"].to_numpy(np.int64) * k + known["l"].to_numpy(np.int64)
        order = np.argsort(codes)
        codes, answered = codes[order], known["answers"].to_numpy(float)[order]
        people, person = np.unique(codes // k, return_inverse=True)
        old = accuracy = None
        weights = np.ones(len(codes))
        for self.rounds in range(1, MAX_ROUNDS + 1):
            if not len(codes):
                break
            sums = self._sums(spark.sparkContext.broadcast((codes, weights)), self.rows.select("x")).toPandas()
            at = np.searchsorted(codes, sums["code"].to_numpy(np.int64))
            right, judged = np.zeros(len(codes)), np.zeros(len(codes))
            right[at], judged[at] = sums["right"], sums["judged"]
            total = lambda x: np.bincount(person, weights=x, minlength=len(people))
            overall = (total(right) + PRIOR_WEIGHT * PRIOR) / (total(judged) + PRIOR_WEIGHT)
            fresh = (right + LABEL_WEIGHT * overall[person]) / (judged + LABEL_WEIGHT)
            stay = self._stay()
            accuracy = fresh if accuracy is None else (1 - stay) * fresh + stay * accuracy
            clipped = np.clip(accuracy, EDGE, 1 - EDGE)
            weights = np.log(max(len(self.labels) - 1, 1) * clipped / (1 - clipped))
            if old is not None and np.abs(right - old).sum() <= STABLE * judged.sum():
                break
            old = right
        else:
            raise RuntimeError("the consensus did not settle")
        self.weights = spark.sparkContext.broadcast((codes, weights))
        if len(codes):
            self.people = spark.createDataFrame(list(zip(people.tolist(), total(answered).tolist(), total(judged).tolist(), overall.tolist())), "w long, n_answers double, n_judged double, reliability double")
        else:
            self.people = spark.createDataFrame([], "w long, n_answers double, n_judged double, reliability double")

    def _stay(self) -> float:
        return 1 - (1 - DAMPING) * min(1.0, SLOW / self.rounds)

    def _sums(self, weights, rows: DataFrame) -> DataFrame:
        """(code, right, judged) of all rows; weights: a broadcast, or None where the rows bring them."""
        k = self.k

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _Batch(b, k, weights and weights.value).judged()], ["code", "right", "judged"])

        return rows.mapInArrow(run, "code long, right double, judged double").groupBy("code").agg(F.sum("right").alias("right"), F.sum("judged").alias("judged"))

    # weights as a table

    def _weighted(self, table: DataFrame | None) -> DataFrame:
        """The rows with a weight beside each vote."""
        if table is None:
            return self.rows.select(*self.item, F.transform("x", lambda v: F.struct(v.w.alias("w"), v.l.alias("l"), v.n.alias("n"), F.lit(1.0).alias("weight"))).alias("x"))
        votes = self.rows.select(*self.item, F.explode("x").alias("v")).select(*self.item, "v.*")
        return votes.join(table.select("w", "l", "weight"), ["w", "l"]).groupBy(*self.item).agg(F.sort_array(F.collect_list(F.struct("w", "l", "n", "weight"))).alias("x"))

    def _run_joined(self) -> None:
        spark, table, path = self.rows.sparkSession, None, None
        for self.rounds in range(1, MAX_ROUNDS + 1):
            sums = self._sums(None, self._weighted(table).select("x")).select(F.expr(f"code div {self.k}").alias("w"), (F.col("code") % self.k).cast("int").alias("l"), "right", "judged")
            j = self.cells.join(sums, ["w", "l"], "left").withColumns({"right": F.coalesce("right", F.lit(0.0)), "judged": F.coalesce("judged", F.lit(0.0))})
            person = j.groupBy("w").agg(F.sum("right").alias("_r"), F.sum("judged").alias("n_judged"), F.sum("answers").alias("n_answers"))
            person = person.withColumn("reliability", (F.col("_r") + PRIOR_WEIGHT * PRIOR) / (F.col("n_judged") + PRIOR_WEIGHT)).drop("_r")
            fresh, moved = (F.col("right") + LABEL_WEIGHT * F.col("reliability")) / (F.col("judged") + LABEL_WEIGHT), F.lit(None).cast("double")
            j = j.join(person, "w")
            if table is not None:
                j = j.join(table.select("w", "l", F.col("accuracy").alias("_a"), F.col("right").alias("_old")), ["w", "l"])
                stay = self._stay()
                fresh, moved = (1 - stay) * fresh + stay * F.col("_a"), F.abs(F.col("right") - F.col("_old"))
            clipped = F.least(F.greatest(fresh, F.lit(EDGE)), F.lit(1 - EDGE))
            new, new_path = written_at(j.select("w", "l", "right", "judged", "n_judged", "n_answers", "reliability", fresh.alias("accuracy"), moved.alias("moved"), F.log(max(len(self.labels) - 1, 1) * clipped / (1 - clipped)).alias("weight")), "weights")
            if path:
                discard(spark, path)
            table, path = new, new_path
            state = table.agg(F.sum("judged").alias("n"), F.sum("moved").alias("d")).first()
            if state["d"] is not None and state["d"] <= STABLE * (state["n"] or 0.0):
                break
        else:
            raise RuntimeError("the consensus did not settle")
        self.table = table
        self.people = table.groupBy("w").agg(F.max("n_answers").alias("n_answers"), F.max("n_judged").alias("n_judged"), F.max("reliability").alias("reliability"))

    # results

    def items(self) -> DataFrame:
        """item columns, label, n_workers, n_answers, agreement (share of equal answers among the pairs of answers of
        different annotators), margin (share of the positive vote that the winner holds)."""
        k, item, weights = self.k, self.item, self.weights if self.small else None
        names = np.array(self.labels or [None], dtype=object)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    r = _Batch(b, k, weights and weights.value).results()
                    own = [pa.array(names[r["best"]], pa.string()), pa.array(r["n_workers"], pa.int64()), pa.array(r["n_answers"], pa.float64()), pa.array(r["agreement"], pa.float64(), mask=r["no_pairs"]), pa.array(r["margin"], pa.float64(), mask=r["no_margin"])]
                    yield pa.RecordBatch.from_arrays([b.column(c) for c in item] + own, [*item, "label", "n_workers", "n_answers", "agreement", "margin"])

        kinds = dict(self.rows.dtypes)
        rows = self.rows if self.small else self._weighted(self.table)
        return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in item) + ", label string, n_workers long, n_answers double, agreement double, margin double")

    def workers(self) -> DataFrame:
        """worker_id, n_answers, n_judged (answers with another annotator), reliability (smoothed leave-one-out accuracy)."""
        return self.people.join(self.names, "w").select("worker_id", "n_answers", "n_judged", "reliability")


def krippendorff(votes: DataFrame, item: list[str] = ITEM) -> DataFrame:
    """One row: observed and expected disagreement and Krippendorff's alpha for nominal labels, which allows for
    missing ratings. An annotator with several answers on an item rates it once, by the label given most often (ties:
    the smallest). Items with one rating are left out; nulls where nothing is comparable."""
    given = votes.groupBy(*item, "worker_id", "label").agg(F.count(F.lit(1)).alias("n"))
    ratings = given.groupBy(*item, "worker_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    per_label = ratings.groupBy(*item, "label").agg(F.count(F.lit(1)).alias("n"))
    per_item = per_label.groupBy(*item).agg(F.sum("n").alias("s"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).filter("s > 1")
    kept = per_label.join(per_item.select(*item), item, "left_semi").groupBy("label").agg(F.sum("n").alias("c"))
    chance = kept.agg(F.sum(F.col("c") * (F.col("c") - 1)).cast("double").alias("e"))
    sums = per_item.agg(F.count(F.lit(1)).alias("n_items"), F.sum("s").alias("n_answers"), F.sum((F.col("s") * (F.col("s") - 1) - F.col("same")) / (F.col("s") - 1)).alias("dis"))
    observed = F.try_divide("dis", "n_answers")
    expected = 1 - F.try_divide(F.col("e"), F.col("n_answers") * (F.col("n_answers") - 1))
    one = sums.crossJoin(chance)  # one row with one row
    return one.select("n_items", "n_answers", observed.alias("observed_disagreement"), expected.alias("expected_disagreement"), (1 - F.try_divide(observed, expected)).alias("alpha"))
