"""Deterministic system outputs, gold labels and votes derived from the order and event tables.

The data folders hold no relations; these views map their rows onto the relation schema, so that every operator on
relations runs over whole tables. Each view has the same definition in SQL (SQL_VIEWS) for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.tables import load

_RELATION = """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'per:title' WHEN l_returnflag = 'R' THEN 'per:employee_or_member_of'
 WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'per:place_of_residence' WHEN l_returnflag = 'A' THEN 'org:founded_by'
 WHEN l_linestatus = 'F' THEN 'org:place_of_headquarters' ELSE 'per:spouse' END"""
_OBJECT_TYPE = "CASE relation WHEN 'per:title' THEN 'TITLE' WHEN 'per:employee_or_member_of' THEN 'ORG' WHEN 'per:place_of_residence' THEN 'GPE' WHEN 'org:place_of_headquarters' THEN 'GPE' ELSE 'PER' END"
_SUBJECT_TYPE = "CASE WHEN relation LIKE 'org:%' THEN 'ORG' ELSE 'PER' END"


def relations(spark: SparkSession, d: str) -> DataFrame:
    """System output: one row per stated relation instance; instance keys repeat on purpose."""
    li = load(spark, d, "lineitem")
    base = li.selectExpr(
        "l_suppkey % 5 AS submission_id", "l_orderkey AS doc_id", "l_linenumber * 100 AS subject_lo", "l_linenumber * 100 + 1 + l_partkey % 20 AS subject_hi",
        "l_linenumber * 100 + 30 + l_suppkey % 10 AS object_lo", "l_linenumber * 100 + 45 + l_partkey % 15 AS object_hi", f"{_RELATION} AS relation",
        "concat('E', l_partkey % 97) AS subject_entity", "concat('O', l_suppkey % 13) AS object_entity", "1 - l_discount AS confidence",
    )
    return base.selectExpr("*", f"{_SUBJECT_TYPE} AS subject_type", f"{_OBJECT_TYPE} AS object_type")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """The distinct argument spans of `relations`."""
    r = relations(spark, d)
    s = r.selectExpr("submission_id", "doc_id", "CAST(subject_lo AS BIGINT) AS lo", "subject_hi AS hi", "subject_type AS mention_type")
    o = r.selectExpr("submission_id", "doc_id", "object_lo AS lo", "object_hi AS hi", "object_type AS mention_type")
    return s.unionByName(o).distinct()


def links(spark: SparkSession, d: str) -> DataFrame:
    """Entity links of about two thirds of the mentions."""
    m = mentions(spark, d).filter("(doc_id + lo) % 3 <> 0")
    return m.groupBy("submission_id", "doc_id", "lo", "hi").agg(F.min(F.expr("concat('wiki:E', (lo + hi) % 97)")).alias("link_name"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Gold relations with a nullable label."""
    r = relations(spark, d).filter("submission_id IN (0, 1)").groupBy("doc_id", "subject_lo", "object_lo").agg(F.min("relation").alias("relation"))
    return r.withColumn("correct", F.expr("CASE WHEN (doc_id + subject_lo) % 7 = 0 THEN NULL ELSE (doc_id + subject_lo) % 3 = 0 END"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Redundant votes: assignment, worker, question, relation, weight 0 or 1, time."""
    e = load(spark, d, "events")
    return e.selectExpr("event_id AS assignment_id", "user_id AS worker_id", "CAST(get_json_object(props, '$.k') AS INT) AS question_id", "event_type AS relation", "CASE WHEN value >= 10 THEN 1 ELSE 0 END AS weight", "ts AS created")


def relation_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes on the relation between two arguments: three of four annotators follow the question, the rest their own mind."""
    return votes(spark, d).selectExpr("assignment_id", "worker_id", "question_id % 11 AS doc_id", "question_id AS subject_lo", "question_id + 40 AS object_lo", "CASE WHEN worker_id % 4 < 3 THEN concat('rel:', question_id % 6) ELSE relation END AS relation", "CASE WHEN weight = 1 THEN 1.0D ELSE 0.75D END AS weight")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with their JSON: each stated relation as the answer of an assignment. By document, these are selective
    answers of both payload versions, exhaustive relations, or exhaustive entities."""
    r = relations(spark, d).selectExpr(
        "concat_ws('-', doc_id, subject_lo, subject_hi, object_lo, object_hi, relation, confidence * 100) AS assignment_id", "CAST(doc_id % 50 % 7 AS INT) AS question_batch_id", "CAST(doc_id % 50 * 10 + subject_lo DIV 100 AS INT) AS question_id", "CAST(doc_id % 50 AS INT) AS doc_id", "CAST(CASE WHEN doc_id % 8 < 3 THEN 0 WHEN doc_id % 8 < 5 THEN 1 WHEN doc_id % 8 < 7 THEN 2 ELSE 3 END AS INT) AS kind",
        "CAST(subject_lo AS INT) AS subject_lo", "CAST(subject_lo + 12 AS INT) AS subject_hi", "CAST(subject_lo + IF(doc_id % 13 = 0, 45, 30) AS INT) AS object_lo", "CAST(subject_lo + IF(doc_id % 13 = 0, 30, 45) AS INT) AS object_hi",
        "IF(confidence > 0.925, 'per:employee_or_member_of', relation) AS relation", "'PER' AS subject_type", "CASE doc_id % 50 % 3 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'ORG' ELSE 'GPE' END AS object_type", "IF(confidence > 0.925, concat('E', doc_id % 50), subject_entity) AS subject_entity", "IF(confidence > 0.925, concat('O', doc_id % 50), object_entity) AS object_entity", "(doc_id + subject_lo) % 5 <> 0 AS ok",
    ).distinct()

    def arg(x: str):
        e, lo, hi, t = (F.col(f"{x}_{c}") for c in ("entity", "lo", "hi", "type"))
        # the new payload has words for types, spans, and the page that was chosen; the old one objects and offsets
        gold = F.when(lo % 3 == 1, e).when(lo % 3 == 2, F.concat(e, F.lit("%27s")))
        new = F.struct(F.concat(F.lit("\u00a0"), e).alias("gloss"), t.alias("type"), F.array(lo, hi).alias("span"), F.struct(F.concat(e, F.lit(" ")).alias("gloss"), F.array(lo, hi).alias("span"), F.concat(F.lit("wiki:"), e).alias("link"), F.col("ok").alias("canonicalCorrect"), gold.alias("linkGold")).alias("entity"))
        old = F.struct(e.alias("gloss"), F.struct(t.alias("name")).alias("type"), lo.alias("doc_char_begin"), hi.alias("doc_char_end"), F.struct(e.alias("gloss"), lo.alias("doc_char_begin"), hi.alias("doc_char_end"), e.alias("link"), F.when(F.col("ok"), "Yes").otherwise("No").alias("canonicalCorrect"), F.when(lo % 2 == 0, "Yes").otherwise("No").alias("linkCorrect")).alias("entity"))
        listed = F.struct(e.alias("gloss"), F.struct(t.alias("name")).alias("type"), lo.alias("doc_char_begin"), hi.alias("doc_char_end"), F.struct(e.alias("gloss"), F.array(lo, hi).alias("span"), F.when(lo % 3 != 0, e).alias("link")).alias("entity"))
        return new, old, listed

    (s0, s1, s3), (o0, o1, o3) = arg("subject"), arg("object")
    name = F.when(F.col("relation") == "per:spouse", "per:sibling").when((F.col("relation") == "org:founded_by") & (F.col("question_seven") == 0), "org:unheard_of").otherwise(F.col("relation")).alias("relation")
    r = r.withColumn("question_seven", F.col("question_batch_id"))
    pair = lambda s, o, *more: F.to_json(F.array(F.struct(s.alias("subject"), name, o.alias("object"), *more)))
    response = F.when(F.col("kind") == 0, pair(s0, o0, F.lit(0.2).alias("version"))).when(F.col("kind") < 3, pair(s1, o1)).otherwise(F.to_json(F.array(s3, o3)))
    kind = F.when(F.col("kind") < 2, "selective_relations").when(F.col("kind") == 2, "exhaustive_relations").otherwise("exhaustive_entities")
    return r.select("assignment_id", "question_batch_id", "question_id", "doc_id", kind.alias("batch_type"), response.alias("response"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Slot-filling runs: run, entity, provenance, value and its equivalence class (0: wrong)."""
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.selectExpr("o_custkey % 7 AS run_id", "l_partkey % 50 AS entity", "l_orderkey % 200 AS prov", "l_suppkey AS slot_value", "CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 0 ELSE 1 + (l_suppkey % 4) END AS eq")


def latest_mentions(spark: SparkSession, d: str) -> DataFrame:
    """submission_mention as it stands: the latest upload of each key, spans as plain columns."""
    from claimscope.operators.ordering import distinct_on

    m = load(spark, d, "submission_mention").selectExpr("submission_id", "doc_id", "span.lo AS lo", "span.hi AS hi", "canonical_span.lo AS c_lo", "canonical_span.hi AS c_hi", "mention_type", "gloss", "updated")
    return distinct_on(m, ["submission_id", "doc_id", "lo", "hi"], [F.col("updated").desc_nulls_last(), F.col("c_lo").asc_nulls_last(), F.col("c_hi").asc_nulls_last(), F.col("mention_type").asc_nulls_last(), F.col("gloss").asc_nulls_last()])


def latest_links(spark: SparkSession, d: str) -> DataFrame:
    from claimscope.operators.ordering import distinct_on

    m = load(spark, d, "submission_link").selectExpr("submission_id", "doc_id", "span.lo AS lo", "span.hi AS hi", "link_name", "confidence", "updated")
    return distinct_on(m, ["submission_id", "doc_id", "lo", "hi"], [F.col("updated").desc_nulls_last(), F.col("link_name").asc_nulls_last(), F.col("confidence").asc_nulls_last()])


def responses(spark: SparkSession, d: str) -> DataFrame:
    """evaluation_mention_response, repeats once, spans as plain columns."""
    return load(spark, d, "evaluation_mention_response").selectExpr(
        "assignment_id", "worker_id", "doc_id", "span.lo AS lo", "span.hi AS hi", "canonical_span.lo AS c_lo", "canonical_span.hi AS c_hi", "created", "question_batch_id", "question_id", "mention_type", "gloss", "weight"
    ).distinct()


SQL_VIEWS = {
    "k_relation": f"""SELECT *, {_SUBJECT_TYPE} AS subject_type, {_OBJECT_TYPE} AS object_type FROM (
 SELECT l_suppkey % 5 AS submission_id, l_orderkey AS doc_id, l_linenumber * 100 AS subject_lo, l_linenumber * 100 + 1 + l_partkey % 20 AS subject_hi,
 l_linenumber * 100 + 30 + l_suppkey % 10 AS object_lo, l_linenumber * 100 + 45 + l_partkey % 15 AS object_hi, {_RELATION} AS relation,
 'E' || (l_partkey % 97) AS subject_entity, 'O' || (l_suppkey % 13) AS object_entity, 1 - l_discount AS confidence FROM lineitem)""",
    "k_mention": """SELECT DISTINCT submission_id, doc_id, lo, hi, mention_type FROM (
 SELECT submission_id, doc_id, CAST(subject_lo AS BIGINT) AS lo, subject_hi AS hi, subject_type AS mention_type FROM k_relation
 UNION ALL SELECT submission_id, doc_id, object_lo, object_hi, object_type FROM k_relation)""",
    "k_link": "SELECT submission_id, doc_id, lo, hi, min('wiki:E' || ((lo + hi) % 97)) AS link_name FROM k_mention WHERE (doc_id + lo) % 3 <> 0 GROUP BY ALL",
    "k_gold": """SELECT doc_id, subject_lo, object_lo, min(relation) AS relation,
 CASE WHEN (doc_id + subject_lo) % 7 = 0 THEN NULL ELSE (doc_id + subject_lo) % 3 = 0 END AS correct FROM k_relation WHERE submission_id IN (0, 1) GROUP BY doc_id, subject_lo, object_lo""",
    "k_vote": """SELECT event_id AS assignment_id, user_id AS worker_id, CAST(json_extract_string(props, '$.k') AS INT) AS question_id, event_type AS relation,
 CASE WHEN value >= 10 THEN 1 ELSE 0 END AS weight, ts AS created FROM events""",
    "k_relvote": """SELECT assignment_id, worker_id, question_id % 11 AS doc_id, question_id AS subject_lo, question_id + 40 AS object_lo,
 CASE WHEN worker_id % 4 < 3 THEN 'rel:' || (question_id % 6) ELSE relation END AS relation, CASE WHEN weight = 1 THEN 1.0 ELSE 0.75 END::DOUBLE AS weight FROM k_vote""",
    "k_answer": """SELECT DISTINCT concat_ws('-', doc_id, subject_lo, subject_hi, object_lo, object_hi, relation, confidence * 100) AS assignment_id, CAST(doc_id % 50 % 7 AS INT) AS question_batch_id, CAST(doc_id % 50 * 10 + subject_lo // 100 AS INT) AS question_id,
 CAST(doc_id % 50 AS INT) AS doc_id, CAST(CASE WHEN doc_id % 8 < 3 THEN 0 WHEN doc_id % 8 < 5 THEN 1 WHEN doc_id % 8 < 7 THEN 2 ELSE 3 END AS INT) AS kind, CAST(subject_lo AS INT) AS subject_lo, CAST(subject_lo + 12 AS INT) AS subject_hi, CAST(subject_lo + CASE WHEN doc_id % 13 = 0 THEN 45 ELSE 30 END AS INT) AS object_lo,
 CAST(subject_lo + CASE WHEN doc_id % 13 = 0 THEN 30 ELSE 45 END AS INT) AS object_hi, CASE WHEN confidence > 0.925 THEN 'per:employee_or_member_of' ELSE relation END AS relation, 'PER' AS subject_type, CASE doc_id % 50 % 3 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'ORG' ELSE 'GPE' END AS object_type, CASE WHEN confidence > 0.925 THEN 'E' || (doc_id % 50) ELSE subject_entity END AS subject_entity, CASE WHEN confidence > 0.925 THEN 'O' || (doc_id % 50) ELSE object_entity END AS object_entity,
 (doc_id + subject_lo) % 5 <> 0 AS ok FROM k_relation""",
    "k_run": """SELECT o_custkey % 7 AS run_id, l_partkey % 50 AS entity, l_orderkey % 200 AS prov, l_suppkey AS slot_value,
 CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 0 ELSE 1 + (l_suppkey % 4) END AS eq FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "m": """SELECT submission_id, doc_id, lo, hi, c_lo, c_hi, mention_type, gloss, updated FROM (
 SELECT submission_id, doc_id, span.lo AS lo, span.hi AS hi, canonical_span.lo AS c_lo, canonical_span.hi AS c_hi, mention_type, gloss, updated FROM submission_mention)
 QUALIFY row_number() OVER (PARTITION BY submission_id, doc_id, lo, hi ORDER BY updated DESC NULLS LAST, c_lo NULLS LAST, c_hi NULLS LAST, mention_type NULLS LAST, gloss NULLS LAST) = 1""",
    "l": """SELECT submission_id, doc_id, lo, hi, link_name, confidence, updated FROM (
 SELECT submission_id, doc_id, span.lo AS lo, span.hi AS hi, link_name, confidence, updated FROM submission_link)
 QUALIFY row_number() OVER (PARTITION BY submission_id, doc_id, lo, hi ORDER BY updated DESC NULLS LAST, link_name NULLS LAST, confidence NULLS LAST) = 1""",
    "r": """SELECT DISTINCT assignment_id, worker_id, doc_id, span.lo AS lo, span.hi AS hi, canonical_span.lo AS c_lo, canonical_span.hi AS c_hi, created,
 question_batch_id, question_id, mention_type, gloss, weight FROM evaluation_mention_response""",
    "s": "SELECT DISTINCT doc_id, span.lo AS lo, span.hi AS hi, sentence_index FROM sentence",
}
_NEEDS = {"k_answer": ["k_relation"], "k_relvote": ["k_vote"], "k_mention": ["k_relation"], "k_link": ["k_relation", "k_mention"], "k_gold": ["k_relation"]}


def sql(body: str, *views: str, more: str = "") -> str:
    """A statement over the named views; more: further common table expressions, each followed by a comma or last."""
    names = [x for v in views for x in [*_NEEDS.get(v, []), v]]
    ctes = [f"{n} AS ({SQL_VIEWS[n]})" for n in dict.fromkeys(names)]
    if more:
        ctes.append(more.strip().rstrip(","))
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body
