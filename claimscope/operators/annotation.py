"""Annotators' votes: merging by majority, quality control, completeness, agreement, gloss repair, extraction from JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.operators.ranges import contained_in
from claimscope.session import checkpointed
from claimscope.sources.sinks import insert_missing


def merge_votes(votes: DataFrame, keys: list[str], label: str, asked: DataFrame | None = None) -> DataFrame:
    """(keys, label, n, of): labels that more than half of a key's expected votes give. asked: (keys, of); by default
    the votes present."""
    n = votes.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    of = asked if asked is not None else n.groupBy(*keys).agg(F.sum("n").alias("of"))
    return n.join(of, keys).filter(F.col("n") * 2 > F.col("of"))


def expected_votes(responses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, of, question_ids, batch_ids): the votes a key could get: over the questions that it occurs in, the sum of
    their assignments, whether these gave the key or not; with the questions and their batches in order."""
    question = ["question_batch_id", "question_id"]
    asked = responses.groupBy(*question).agg(F.countDistinct("assignment_id").alias("n"))
    per = responses.select(*keys, *question).distinct().join(asked, question)
    return per.groupBy(*keys).agg(F.sum("n").cast("double").alias("of"), F.array_sort(F.collect_set("question_id")).alias("question_ids"), F.array_sort(F.collect_set("question_batch_id")).alias("batch_ids"))


def _pairs(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counted spans, pairs of a span with a longer one of its type around it). Only weight 1 counts. Equal spans are
    counted before the join, so that copies cost no pairs, and the join runs in bins of the text."""
    spans = mentions.filter("weight = 1").groupBy("doc_id", "mention_type", "lo", "hi").agg(F.count(F.lit(1)).alias("k"))
    outer = spans.select("doc_id", "mention_type", F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), F.col("k").alias("ok"))
    return spans, contained_in(spans, outer, ["doc_id", "mention_type"]).filter("NOT (lo = o_lo AND hi = o_hi)")


def span_clique_counts(mentions: DataFrame) -> DataFrame:
    """(doc_id, mention_type, lo, hi, pairs, votes): per span the pairs of votes in which another span of its type
    contains it, or another annotator gave the same span: the inner span gets the pair. votes = 0.5 + sqrt(0.25 + 2
    pairs), the size of the clique with so many pairs. A span without a pair has no row."""
    spans, inside = _pairs(mentions)
    strict = inside.groupBy("doc_id", "mention_type", "lo", "hi").agg(F.sum(F.col("k") * F.col("ok")).alias("p"))
    j = spans.join(strict, ["doc_id", "mention_type", "lo", "hi"], "left")
    pairs = F.coalesce("p", F.lit(0)) + (F.col("k") * (F.col("k") - 1) / 2).cast("long")
    return j.select("doc_id", "mention_type", "lo", "hi", pairs.alias("pairs")).filter("pairs > 0").withColumn("votes", 0.5 + F.sqrt(0.25 + 2 * F.col("pairs")))


def winning_spans(counted: DataFrame) -> DataFrame:
    """(doc_id, lo, hi, win_lo, win_hi, win_type, votes, of): the span each counted span is merged into. counted: doc_id,
    lo, hi, mention_type, votes, of. Within a document the rows are scanned by (lo, hi, votes, type); those that begin
    before the current winner ends form a window, in which a longer span with more than half of its expected votes
    takes over; a window counts if its winner has more than half. The window's extent depends on the winner so far, so
    this is one pass per document in Python; a document's distinct spans are bounded by its text."""

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf[["lo", "hi", "votes", "of", "mention_type"]].itertuples(index=False), key=lambda r: (r.lo, r.hi, r.votes, r.mention_type))
        doc, out, window, win = pdf["doc_id"].iloc[0], [], [], None

        def close():
            if win is not None and win.votes > win.of / 2:
                out.extend((doc, lo, hi, win.lo, win.hi, win.mention_type, win.votes, win.of) for lo, hi in sorted(set(window)))

        for r in rows:
            if win is None or r.lo >= win.hi:
                close()
                window, win = [(r.lo, r.hi)], r
                continue
            window.append((r.lo, r.hi))
            if r.hi - r.lo > win.hi - win.lo and r.votes > r.of / 2:
                win = r
        close()
        return pd.DataFrame(out, columns=["doc_id", "lo", "hi", "win_lo", "win_hi", "win_type", "votes", "of"])

    kind = dict(counted.dtypes)["doc_id"]
    return counted.groupBy("doc_id").applyInPandas(sweep, f"doc_id {kind}, lo int, hi int, win_lo int, win_hi int, win_type string, votes double, of double")


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """(doc_id, lo, hi, mention_type, gloss, c_lo, c_hi, weight): merged mentions of a document. Type and votes are the
    winner's, weight its votes over the expected ones. The gloss is the most frequent of its pairs' inner votes (nulls
    don't count), the canonical span the most frequent of its pairs' votes on both sides, each mapped to the winner of
    its window; where most of these have no winner, it is the span itself. Ties go to the smallest, null last."""
    key = ["doc_id", "mention_type", "lo", "hi"]
    counted = span_clique_counts(mentions)
    of = expected_votes(mentions, ["doc_id", "lo", "hi"]).select("doc_id", "lo", "hi", "of")
    won = checkpointed(winning_spans(counted.join(of, ["doc_id", "lo", "hi"]).select("doc_id", "lo", "hi", "mention_type", "votes", "of")))
    best = won.select("doc_id", F.col("win_lo").alias("lo"), F.col("win_hi").alias("hi"), F.col("win_type").alias("mention_type"), (F.col("votes") / F.col("of")).alias("weight")).distinct()

    # how often each vote takes part in a pair: beside its equals, and inside or around other spans
    spans, inside = _pairs(mentions)
    around = inside.groupBy(*key).agg(F.sum("ok").alias("around"))
    order = Window.partitionBy(*key).orderBy("assignment_id", "gloss", "c_lo", "c_hi")
    votes = mentions.filter("weight = 1").withColumn("before", F.row_number().over(order) - 1)
    votes = votes.join(best.select(*key), key, "left_semi").join(spans, key).join(around, key, "left").withColumn("around", F.coalesce("around", F.lit(0)))
    glosses = votes.filter(F.col("gloss").isNotNull()).groupBy(*key, "gloss").agg(F.sum(F.col("k") - 1 - F.col("before") + F.col("around")).alias("n"))
    gloss = glosses.filter("n > 0").groupBy(*key).agg(F.min_by("gloss", F.struct(-F.col("n"), "gloss")).alias("gloss"))

    own = votes.groupBy(*key, "c_lo", "c_hi").agg(F.sum(F.col("k") - 1 + F.col("around")).alias("n"))
    held = mentions.filter("weight = 1").groupBy("doc_id", "mention_type", F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), "c_lo", "c_hi").agg(F.count(F.lit(1)).alias("m"))
    outer = inside.join(best.select(*key), key, "left_semi").join(held, ["doc_id", "mention_type", "o_lo", "o_hi"]).groupBy(*key, "c_lo", "c_hi").agg(F.sum(F.col("k") * F.col("m")).alias("n"))
    mapped = won.select("doc_id", F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), F.struct(F.col("win_lo").alias("lo"), F.col("win_hi").alias("hi")).alias("canon"))
    canon = own.unionByName(outer).join(mapped, ["doc_id", "c_lo", "c_hi"], "left").groupBy(*key, "canon").agg(F.sum("n").alias("n")).filter("n > 0")
    chosen = canon.groupBy(*key).agg(F.min_by("canon", F.struct(-F.col("n"), F.col("canon").isNull(), F.col("canon"))).alias("canon"))
    j = best.join(gloss, key, "left").join(chosen, key, "left")
    return j.select("doc_id", "lo", "hi", "mention_type", "gloss", F.coalesce("canon.lo", "lo").alias("c_lo"), F.coalesce("canon.hi", "hi").alias("c_hi"), "weight")


def merge_facts(votes: DataFrame, keys: list[str], facts: list[str], asked: DataFrame) -> DataFrame:
    """(keys, facts, weight): links or relations that hold more than half of their key's expected votes. votes: keys,
    facts, weight; asked: (keys, of). The weight is the sum of the votes' weights over the expected votes."""
    n = votes.groupBy(*keys, *facts).agg(F.sum("weight").alias("n"))
    j = n.join(asked.select(*keys, "of"), keys).withColumn("weight", F.try_divide(F.col("n"), F.col("of")))
    return j.filter("weight > 0.5").select(*keys, *facts, "weight")


def with_canonical_links(links: DataFrame, merged: DataFrame) -> DataFrame:
    """links (doc_id, lo, hi, link_name, correct, weight) and, where it lacks the key (doc_id, lo, hi, link_name), a true
    link to the gloss of each merged mention's canonical mention with that mention's weight."""
    canon = merged.select("doc_id", F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), F.concat(F.lit("gloss:"), "gloss").alias("link_name"), F.lit(True).alias("correct"), "weight")
    new = merged.select("doc_id", "lo", "hi", "c_lo", "c_hi").join(canon, ["doc_id", "c_lo", "c_hi"]).filter(F.col("link_name").isNotNull())
    return insert_missing(links, new.select(*links.columns), ["doc_id", "lo", "hi", "link_name"])


def worker_agreement(votes: DataFrame, item: list[str], label: str) -> DataFrame:
    """(worker_id, n, disagree, bad): votes against the majority label of their item; bad beyond a fifth and ten."""
    majority = merge_votes(votes, item, label).select(*item, F.col(label).alias("_gold"))
    j = votes.join(majority, item)
    per = j.groupBy("worker_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) != F.col("_gold")).alias("disagree"))
    return per.withColumn("bad", (F.col("disagree") / F.col("n") > 0.2) & (F.col("disagree") > 10))


def mention_counts_check(mentions: DataFrame) -> DataFrame:
    """(question_batch_id, question_id, assignment_id, n, z, ok): mentions of an assignment over the question's mean."""
    n = mentions.groupBy("question_batch_id", "question_id", "assignment_id").agg(F.count(F.lit(1)).alias("n"))
    q = n.groupBy("question_batch_id", "question_id").agg(F.avg("n").alias("_m"))
    return n.join(q, ["question_batch_id", "question_id"]).select("question_batch_id", "question_id", "assignment_id", "n", (F.col("n") / F.col("_m")).alias("z"), (F.col("n") / F.col("_m") > 0.5).alias("ok"))


def fleiss_kappa(votes: DataFrame, item: list[str], label: str, raters: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, raters, n_items, kappa): Fleiss' kappa over the items with each number of votes, or only those with `raters`;
    by: columns of the item to split by."""
    by = by or []
    n = votes.groupBy(*item, label).agg(F.count(F.lit(1)).alias("n"))
    full = n.groupBy(*item).agg(F.sum("n").alias("raters"), F.sum(F.col("n") * F.col("n")).alias("sq")).filter(F.col("raters") == raters if raters else F.col("raters") > 1)
    group = [*by, "raters"]
    share = n.join(full.select(*item, "raters"), item).groupBy(*group, label).agg(F.sum("n").alias("c"))
    e = share.groupBy(*group).agg(F.sum("c").alias("_t"), F.sum(F.col("c").cast("double") * F.col("c")).alias("_s")).select(*group, F.try_divide("_s", F.col("_t").cast("double") * F.col("_t")).alias("pe"))
    o = full.groupBy(*group).agg(F.count(F.lit(1)).alias("n_items"), F.avg((F.col("sq") - F.col("raters")) / (F.col("raters") * (F.col("raters") - 1))).alias("pa"))
    return o.join(e, group).select(*group, "n_items", F.try_divide(F.col("pa") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def pooled_kappa(kappas: DataFrame) -> DataFrame:
    """One row: the mean of the kappas of odd numbers of raters, weighted by their items; null kappas don't count."""
    odd = kappas.filter("raters % 2 = 1 AND kappa IS NOT NULL")
    return odd.agg(F.sum("n_items").alias("n_items"), F.try_divide(F.sum(F.col("kappa") * F.col("n_items")), F.sum("n_items")).alias("kappa"))


def sanitised(gloss: Column, text: Column, suggested: Column, s_lo: Column, s_hi: Column) -> Column:
    """What to do with an answer's gloss, given the document's text under the span and the best overlapping mention."""
    own = F.replace(gloss, F.lit("``"), F.lit('"'))
    shown = text
    for a, b in (("&amp;", "&"), ("’", "'"), ("“", '"')):
        shown = F.replace(shown, F.lit(a), F.lit(b))
    fits = suggested.isNotNull() & (F.char_length(suggested) == s_hi - s_lo)
    return F.when(text.isNull(), "Delete").when(gloss == text, "Correct").when(own == shown, "Replace gloss").when(fits, "Replace with suggested").otherwise("Replace gloss")


def question_arguments(questions: DataFrame) -> DataFrame:
    """(batch_id, id, role, lo, hi, gloss, mention_type, link) of selective questions, all payload versions: types as
    text or as an object with a name, offsets as numbers or text; in the oldest one mention_1 and mention_2 are
    [doc_id, lo, hi] of subject and object, and nothing else is known of them. Unreadable JSON and empty spans give no rows."""
    q = questions.select("batch_id", "id", "params").distinct()
    at = lambda p: F.get_json_object("params", p)
    end = lambda r, old, i: F.coalesce(at(f"$.{r}.span[{i}]"), at(f"$.{old}[{i + 1}]")).try_cast("int")
    role = lambda r, old: F.struct(F.lit(r).alias("role"), end(r, old, 0).alias("lo"), end(r, old, 1).alias("hi"), at(f"$.{r}.gloss").alias("gloss"), F.coalesce(at(f"$.{r}.type.name"), at(f"$.{r}.type")).alias("mention_type"), at(f"$.{r}.entity.link").alias("link"))
    x = q.select("batch_id", "id", F.explode(F.array(role("subject", "mention_1"), role("object", "mention_2"))).alias("x")).select("batch_id", "id", "x.*")
    return x.filter("lo < hi")


def exhaustive_mentions(questions: DataFrame) -> DataFrame:
    """(batch_id, id, lo, hi, gloss, mention_type, link) of the mention lists of exhaustive questions."""
    schema = "array<struct<gloss:string,type:string,doc_char_begin:int,doc_char_end:int,entity:struct<link:string>>>"
    q = questions.select("batch_id", "id", "params").distinct()
    m = q.select("batch_id", "id", F.explode(F.from_json(F.get_json_object("params", "$.mentions"), schema)).alias("m"))
    kind = F.coalesce(F.get_json_object("m.type", "$.name"), F.col("m.type"))
    return m.select("batch_id", "id", F.col("m.doc_char_begin").alias("lo"), F.col("m.doc_char_end").alias("hi"), F.col("m.gloss").alias("gloss"), kind.alias("mention_type"), F.col("m.entity.link").alias("link")).filter("lo < hi")


def completeness(assignments: DataFrame, units: DataFrame, unit: str, done: Column, wanted: str) -> DataFrame:
    """(unit, n, complete): done assignments against the wanted number; units without any are incomplete."""
    n = assignments.filter(done).groupBy(unit).agg(F.count(F.lit(1)).alias("n"))
    return units.join(n, unit, "left").select(unit, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.col(wanted)).alias("complete"))
