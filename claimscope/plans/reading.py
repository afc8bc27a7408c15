"""Queries of read models, exports and closures over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.operators import annotation as ann
from claimscope.operators import slotfilling as sf
from claimscope.operators import states
from claimscope.operators.estimators import systems_of
from claimscope.plans.evaluation import _EXPECTED
from claimscope.sources import derived as k
from claimscope.sources.derived import sql
from claimscope.tables import load

QUERIES, SQL = {}, {}


def query(body: str | None = None, *with_views: str, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = sql(body, *with_views, more=more) if with_views or more else body
        return f

    return add


@query("""SELECT p.submission_id, b.corpus_tag, b.distribution_type, count(*) AS n FROM (SELECT DISTINCT batch_id, submission_id, doc_id, subject, "object" FROM submission_sample) p
 JOIN (SELECT DISTINCT id, corpus_tag, distribution_type FROM sample_batch) b ON p.batch_id = b.id GROUP BY ALL""")
def sampled_instances(s: SparkSession, d: str) -> DataFrame:
    """Samples of each submission by corpus and distribution."""
    p = load(s, d, "submission_sample").select("batch_id", "submission_id", "doc_id", "subject", "object").distinct()
    b = load(s, d, "sample_batch").select(F.col("id").alias("batch_id"), "corpus_tag", "distribution_type").distinct()
    return p.join(b, "batch_id").groupBy("submission_id", "corpus_tag", "distribution_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT g.doc_id, g.subject_lo, g.object_lo, u.submission_id, coalesce(g.correct AND r.x IS NOT NULL, false) AS label FROM k_gold g, (SELECT DISTINCT submission_id FROM k_relation) u
 LEFT JOIN (SELECT DISTINCT submission_id, doc_id, subject_lo, object_lo, 1 AS x FROM k_relation) r ON r.submission_id = u.submission_id AND r.doc_id = g.doc_id AND r.subject_lo = g.subject_lo AND r.object_lo = g.object_lo""", "k_relation", "k_gold")
def exhaustive_labels(s: SparkSession, d: str) -> DataFrame:
    """Gold beside every submission, with whether it states it rightly; the result has a row for each of both."""
    r = k.relations(s, d)
    systems = F.array(*map(F.lit, systems_of(r, "submission_id")))  # their number is checked
    stated = r.select("submission_id", "doc_id", "subject_lo", "object_lo").distinct().withColumn("x", F.lit(True))
    g = k.gold(s, d).withColumn("submission_id", F.explode(systems))
    j = g.join(stated, ["submission_id", "doc_id", "subject_lo", "object_lo"], "left")
    return j.select("doc_id", "subject_lo", "object_lo", "submission_id", F.coalesce(F.col("correct") & F.col("x").isNotNull(), F.lit(False)).alias("label"))


@query("""SELECT DISTINCT b.id AS batch_id, b.batch_type, sb.id AS sample_batch_id FROM (SELECT DISTINCT q.batch_id FROM evaluation_question q SEMI JOIN r ON q.batch_id = r.question_batch_id AND q.id = r.question_id) x
 JOIN evaluation_batch b ON x.batch_id = b.id LEFT JOIN sample_batch sb ON b.sample_batch_id = sb.id""", "r")
def answered_batches(s: SparkSession, d: str) -> DataFrame:
    """The batches an export of answers needs: those with an answered question, with their sample batches."""
    r = k.responses(s, d).select(F.col("question_batch_id").alias("batch_id"), F.col("question_id").alias("id"))
    x = load(s, d, "evaluation_question").join(r, ["batch_id", "id"], "left_semi").select("batch_id").distinct()
    b = load(s, d, "evaluation_batch").select(F.col("id").alias("batch_id"), "batch_type", F.col("sample_batch_id").alias("_sb"))
    sb = load(s, d, "sample_batch").select(F.col("id").alias("sample_batch_id"))
    return x.join(b, "batch_id").join(sb, F.col("_sb") == F.col("sample_batch_id"), "left").select("batch_id", "batch_type", "sample_batch_id").distinct()


@query("SELECT doc_id, lo, hi, of AS expected, array_to_string(qs, ' ') AS question_ids, array_to_string(bs, ' ') AS batch_ids FROM ev", "r", more=_EXPECTED)
def denominators(s: SparkSession, d: str) -> DataFrame:
    """Expected votes of each span, with the questions and batches that it was part of."""
    e = ann.expected_votes(k.responses(s, d), ["doc_id", "lo", "hi"])
    return e.select("doc_id", "lo", "hi", F.col("of").alias("expected"), F.array_join("question_ids", " ").alias("question_ids"), F.array_join(F.transform("batch_ids", lambda x: x.cast("string")), " ").alias("batch_ids"))


@query("""SELECT submission_id, link_name, doc_id, n_mentions, type_name FROM (SELECT m.submission_id, l.link_name, m.doc_id, count(*) AS n_mentions FROM m JOIN l USING (submission_id, doc_id, lo, hi) GROUP BY ALL)
 JOIN (SELECT submission_id, link_name, doc_id, mention_type AS type_name FROM (SELECT m.submission_id, l.link_name, m.doc_id, m.mention_type, count(*) AS n FROM m JOIN l USING (submission_id, doc_id, lo, hi) GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY submission_id, link_name, doc_id ORDER BY n DESC, mention_type NULLS LAST) = 1) USING (submission_id, link_name, doc_id)""", "m", "l")
def entity_export(s: SparkSession, d: str) -> DataFrame:
    """Entities of a submission per document: number of mentions and their most frequent type."""
    from claimscope.operators.ordering import mode_with_nulls

    key = ["submission_id", "link_name", "doc_id"]
    j = k.latest_mentions(s, d).select("submission_id", "doc_id", "lo", "hi", "mention_type").join(k.latest_links(s, d).select("submission_id", "doc_id", "lo", "hi", "link_name"), ["submission_id", "doc_id", "lo", "hi"]).filter(F.col("link_name").isNotNull())
    n = j.groupBy(*key).agg(F.count(F.lit(1)).alias("n_mentions"))
    return n.join(mode_with_nulls(j, key, "mention_type", "type_name"), key)


@query("""SELECT round(avg(abs(a.f1 - b.f1)), 8) AS mean_gap, round(median(abs(a.f1 - b.f1)), 8) AS median_gap FROM x a JOIN x b ON a.rk = b.rk + 1""", "k_run",
       more="""g AS (SELECT entity, slot_value, max(eq) AS eq FROM k_run GROUP BY ALL), o AS (SELECT DISTINCT run_id, entity, slot_value FROM k_run),
es AS (SELECT run_id, entity, count(*)::DOUBLE AS s, count(DISTINCT CASE WHEN eq > 0 THEN eq END)::DOUBLE AS c FROM o JOIN g USING (entity, slot_value) GROUP BY ALL),
et AS (SELECT entity, count(DISTINCT CASE WHEN eq > 0 THEN eq END)::DOUBLE AS t FROM g GROUP BY entity),
f AS (SELECT run_id, avg(CASE WHEN c > 0 THEN 2 * (c / s) * (c / t) / (c / s + c / t) ELSE 0 END) AS f1 FROM es JOIN et USING (entity) GROUP BY run_id),
x AS (SELECT f1, row_number() OVER (ORDER BY f1, run_id) AS rk FROM f)""")
def adjacent_gaps(s: SparkSession, d: str) -> DataFrame:
    """Gaps between runs of adjacent rank."""
    r = k.runs(s, d)
    f = sf.macro(sf.entity_scores(r, r, "anydoc")).selectExpr("run_id", "f1", "lag(f1) OVER (ORDER BY f1, run_id) AS before")  # one row per run
    gap = F.abs(F.col("f1") - F.col("before"))
    return f.filter("before IS NOT NULL").agg(F.round(F.avg(gap), 8).alias("mean_gap"), F.round(F.median(gap), 8).alias("median_gap"))


@query("""SELECT position, round(avg(length), 6) AS mean_length, count(*) AS n FROM (SELECT unnest(list_transform(token_spans, lambda t: t.hi - t.lo)) AS length, generate_subscripts(token_spans, 1) - 1 AS position FROM (SELECT DISTINCT doc_id, span, token_spans FROM sentence)) GROUP BY position""")
def mean_by_position(s: SparkSession, d: str) -> DataFrame:
    """Means by position over sequences of different length."""
    t = load(s, d, "sentence").select("doc_id", "span", "token_spans").distinct().select(F.posexplode("token_spans").alias("position", "t"))
    return t.groupBy(F.col("position").cast("long").alias("position")).agg(F.round(F.avg(F.col("t.hi") - F.col("t.lo")), 6).alias("mean_length"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT batch_id, id, CASE WHEN batch_id IN (SELECT id FROM evaluation_batch WHERE corpus_tag = 'heldout') AND state <> 'error' THEN 'revoked' ELSE state END AS state FROM evaluation_question")
def revoked_questions(s: SparkSession, d: str) -> DataFrame:
    """Questions with those of one corpus revoked."""
    b = load(s, d, "evaluation_batch").filter("corpus_tag = 'heldout'").select(F.col("id").alias("batch_id"))
    return states.revoked(load(s, d, "evaluation_question").select("batch_id", "id", "state").distinct(), b)


@query("SELECT u.name, u.corpus_tag, count(DISTINCT m.doc_id) AS n_docs, count(*) AS n_mentions FROM submission u JOIN m ON u.id = m.submission_id WHERE u.active GROUP BY ALL ORDER BY n_mentions DESC, u.name LIMIT 10", "m")
def active_submissions(s: SparkSession, d: str) -> DataFrame:
    """The ten active submissions with most mentions."""
    u = load(s, d, "submission").filter("active").select(F.col("id").alias("submission_id"), "name", "corpus_tag")
    n = k.latest_mentions(s, d).groupBy("submission_id", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    g = n.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("c").alias("n_mentions")).join(u, "submission_id")
    return g.groupBy("name", "corpus_tag").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_mentions").alias("n_mentions")).orderBy(F.desc("n_mentions"), "name").limit(10)
