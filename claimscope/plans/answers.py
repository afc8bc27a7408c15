"""Queries of facts from annotators' answers and their merge into gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.operators import extraction as ex
from claimscope.plans.evaluation import _MERGED
from claimscope.sources import derived as k
from claimscope.sources.derived import sql

QUERIES, SQL = {}, {}


def query(body: str | None = None, *with_views: str, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = sql(body, *with_views, more=more) if with_views or more else body
        return f

    return add


# both arguments of every answer as rows; kind 0: selective, new payload, 1: old payload, 2: exhaustive relations, 3: entities
_ARGS = """ka AS (SELECT assignment_id, question_batch_id, question_id, doc_id, kind, subject_lo AS lo, subject_hi AS hi, subject_type AS t, subject_entity AS e, ok FROM k_answer
 UNION ALL SELECT assignment_id, question_batch_id, question_id, doc_id, kind, object_lo, object_hi, object_type, object_entity, ok FROM k_answer),
kg AS (SELECT *, CASE WHEN lo % 3 = 1 THEN e WHEN lo % 3 = 2 THEN e || '''s' END AS gold FROM ka WHERE lo < hi),
fm AS (SELECT DISTINCT assignment_id, question_batch_id, question_id, doc_id, lo, hi, lo AS c_lo, hi AS c_hi, t AS mention_type, e AS gloss, CASE WHEN kind = 3 OR ok THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM kg WHERE kind <> 2),
fl AS (SELECT DISTINCT assignment_id, question_batch_id, question_id, doc_id, lo, hi, link_name, correct, 1.0::DOUBLE AS weight FROM (
 SELECT *, 'gloss:' || e AS link_name, ok AS correct FROM kg WHERE (kind = 0 AND t IN ('PER', 'ORG', 'GPE')) OR kind = 1
 UNION ALL SELECT *, 'wiki:' || e, false FROM kg WHERE kind = 0 AND t IN ('PER', 'ORG', 'GPE') AND (gold IS NULL OR gold <> e)
 UNION ALL SELECT *, 'wiki:' || gold, true FROM kg WHERE kind = 0 AND t IN ('PER', 'ORG', 'GPE') AND gold IS NOT NULL
 UNION ALL SELECT *, 'wiki:', true FROM kg WHERE kind = 0 AND t IN ('PER', 'ORG', 'GPE') AND gold IS NULL AND ok
 UNION ALL SELECT *, 'wiki:' || e, lo % 2 = 0 FROM kg WHERE kind = 1
 UNION ALL SELECT *, 'wiki:' || CASE WHEN lo % 3 = 0 THEN '' ELSE e END, true FROM kg WHERE kind = 3 AND t IN ('PER', 'ORG', 'GPE')
 UNION ALL SELECT *, 'gloss:' || e, true FROM kg WHERE kind = 3 AND t IN ('PER', 'ORG', 'GPE'))),
fr AS (SELECT DISTINCT assignment_id, question_batch_id, question_id, doc_id, subject_lo, subject_hi, object_lo, object_hi, CASE relation WHEN 'per:spouse' THEN 'per:siblings' ELSE relation END AS relation, 1.0::DOUBLE AS weight
 FROM k_answer WHERE kind < 3 AND subject_lo < subject_hi AND object_lo < object_hi AND NOT (relation = 'org:founded_by' AND question_batch_id = 0))"""


@query("SELECT * FROM fm", "k_answer", more=_ARGS)
def answer_mentions(s: SparkSession, d: str) -> DataFrame:
    return ex.mention_facts(k.answers(s, d))


@query("SELECT * FROM fl", "k_answer", more=_ARGS)
def answer_links(s: SparkSession, d: str) -> DataFrame:
    return ex.link_facts(k.answers(s, d))


@query("SELECT * FROM fr", "k_answer", more=_ARGS)
def answer_relations(s: SparkSession, d: str) -> DataFrame:
    return ex.relation_facts(k.answers(s, d))


@query("SELECT CASE question_batch_id WHEN 5 THEN 'survey' END AS batch_type, count(*) AS n FROM k_answer WHERE question_batch_id > 4 GROUP BY ALL", "k_answer")
def unread_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers to kinds of questions nobody reads (batches 5 and 6 are given such kinds)."""
    odd = F.when(F.col("question_batch_id") == 5, "survey").when(F.col("question_batch_id") < 5, F.col("batch_type"))
    return ex.unread(k.answers(s, d).withColumn("batch_type", odd))


@query("SELECT assignment_id, doc_id, lo, hi, mention_type, weight FROM (SELECT * FROM fm WHERE question_batch_id <> 3 UNION ALL SELECT * REPLACE (mention_type || '*' AS mention_type) FROM fm WHERE question_batch_id = 3)", "k_answer", more=_ARGS)
def replaced_answers(s: SparkSession, d: str) -> DataFrame:
    """Mentions with those of one batch's assignments read anew (here: with a mark on the type)."""
    facts, a = ex.mention_facts(k.answers(s, d)), k.answers(s, d)
    new = facts.withColumn("mention_type", F.concat("mention_type", F.lit("*")))
    return ex.replaced(facts, new, a.filter("question_batch_id = 3")).select("assignment_id", "doc_id", "lo", "hi", "mention_type", "weight")


@query("SELECT scope, count(*) AS n FROM (SELECT 'all' AS scope FROM fr UNION ALL SELECT 'batches' FROM fr SEMI JOIN (SELECT DISTINCT doc_id FROM fr WHERE question_batch_id = 2) USING (doc_id) UNION ALL SELECT 'documents' FROM fr SEMI JOIN (SELECT DISTINCT doc_id FROM fr WHERE relation = 'per:siblings') USING (doc_id) UNION ALL SELECT 'questions' FROM fr SEMI JOIN (SELECT DISTINCT doc_id FROM fr WHERE question_batch_id = 1 AND question_id % 3 = 0) USING (doc_id)) GROUP BY scope", "k_answer", more=_ARGS)
def scoped_relations(s: SparkSession, d: str) -> DataFrame:
    """Facts in each kind of scope of a merge."""
    r = ex.relation_facts(k.answers(s, d))
    scopes = {"all": None, "batches": r.filter("question_batch_id = 2"), "documents": r.filter("relation = 'per:siblings'"), "questions": r.filter("question_batch_id = 1 AND question_id % 3 = 0")}
    parts = [ex.in_scope(r, m, x).select(F.lit(m).alias("scope")) for m, x in scopes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


_AQ = "aq AS (SELECT question_batch_id, question_id, count(DISTINCT assignment_id) AS n FROM k_answer GROUP BY ALL)"


@query("""SELECT f.doc_id, f.subject_lo, f.subject_hi, f.object_lo, f.object_hi, f.relation, round(sum(f.weight) / x.of, 8) AS weight FROM fr f JOIN x USING (doc_id, subject_lo, subject_hi, object_lo, object_hi) GROUP BY f.doc_id, f.subject_lo, f.subject_hi, f.object_lo, f.object_hi, f.relation, x.of HAVING sum(f.weight) / x.of > 0.5""",
       "k_answer", more=_ARGS + ",\n" + _AQ + ",\nx AS (SELECT doc_id, subject_lo, subject_hi, object_lo, object_hi, sum(n)::DOUBLE AS of FROM (SELECT DISTINCT doc_id, subject_lo, subject_hi, object_lo, object_hi, question_batch_id, question_id FROM fr) JOIN aq USING (question_batch_id, question_id) GROUP BY ALL)")
def gold_relations(s: SparkSession, d: str) -> DataFrame:
    """Relations from the answers' JSON to gold."""
    return ex.merged_relations(k.answers(s, d)).withColumn("weight", F.round("weight", 8))


@query("""SELECT doc_id, lo, hi, link_name, correct, round(weight, 8) AS weight FROM (SELECT f.doc_id, f.lo, f.hi, f.link_name, f.correct, sum(f.weight) / x.of AS weight FROM fl f JOIN x ON f.doc_id = x.doc_id AND f.lo = x.lo AND f.hi = x.hi AND f.link_name = x.link_name GROUP BY f.doc_id, f.lo, f.hi, f.link_name, f.correct, x.of HAVING sum(f.weight) / x.of > 0.5)
 WHERE starts_with(link_name, 'wiki:')""", "k_answer", more=_ARGS + ",\n" + _AQ + ",\nx AS (SELECT doc_id, lo, hi, link_name, sum(n)::DOUBLE AS of FROM (SELECT DISTINCT doc_id, lo, hi, link_name, question_batch_id, question_id FROM fl) JOIN aq USING (question_batch_id, question_id) GROUP BY ALL)")
def gold_wiki_links(s: SparkSession, d: str) -> DataFrame:
    """Links to pages, true and false ones, from the answers' JSON to gold."""
    return ex.merged_links(k.answers(s, d)).filter(F.col("link_name").startswith("wiki:")).withColumn("weight", F.round("weight", 8))


@query("SELECT table_name, n FROM (SELECT 'mentions' AS table_name, count(*) AS n FROM mm UNION ALL SELECT 'relations', count(*) FROM rr UNION ALL SELECT 'links', count(*) FROM (SELECT doc_id, lo, hi, link_name FROM ll UNION SELECT x.doc_id, x.lo, x.hi, 'gloss:' || y.gloss FROM mm x JOIN mm y ON x.doc_id = y.doc_id AND x.c_lo = y.lo AND x.c_hi = y.hi WHERE y.gloss IS NOT NULL))", "k_answer", more=_ARGS + ",\n" + _AQ.replace("aq AS", "ak AS") + ",\n"
       + "r AS (SELECT * FROM fm),\n" + _MERGED + """,
lx AS (SELECT doc_id, lo, hi, link_name, sum(n)::DOUBLE AS of FROM (SELECT DISTINCT doc_id, lo, hi, link_name, question_batch_id, question_id FROM fl) JOIN ak USING (question_batch_id, question_id) GROUP BY ALL),
ll AS (SELECT f.doc_id, f.lo, f.hi, f.link_name, f.correct FROM fl f JOIN lx USING (doc_id, lo, hi, link_name) GROUP BY f.doc_id, f.lo, f.hi, f.link_name, f.correct, lx.of HAVING sum(f.weight) / lx.of > 0.5),
rx AS (SELECT doc_id, subject_lo, subject_hi, object_lo, object_hi, sum(n)::DOUBLE AS of FROM (SELECT DISTINCT doc_id, subject_lo, subject_hi, object_lo, object_hi, question_batch_id, question_id FROM fr) JOIN ak USING (question_batch_id, question_id) GROUP BY ALL),
rr AS (SELECT 1 FROM fr f JOIN rx USING (doc_id, subject_lo, subject_hi, object_lo, object_hi) GROUP BY f.doc_id, f.subject_lo, f.subject_hi, f.object_lo, f.object_hi, f.relation, rx.of HAVING sum(f.weight) / rx.of > 0.5)""")
def gold_tables(s: SparkSession, d: str) -> DataFrame:
    """The whole merge, from JSON to the three gold tables: rows of each."""
    counts = [t.select(F.lit(name).alias("table_name")) for name, t in ex.merged(k.answers(s, d)).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
