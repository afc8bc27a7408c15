"""Queries of the general data-quality operators: orphan references and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.operators import nested
from claimscope.operators.orphans import Parent, Reference, joined_key, orphan_report, orphans
from claimscope.tables import load


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a valid record, one row each."""
    c = F.col
    span = lambda x: [c(f"{x}.lo"), c(f"{x}.hi")]
    references = [
        Reference("submission_sample", load(spark, d, "submission_sample"), F.concat_ws("|", "submission_id", "doc_id", *span("subject"), *span("object"), "batch_id"), c("submission_id"), c("created"), "submission"),
        Reference("evaluation_mention_response", load(spark, d, "evaluation_mention_response"), F.concat_ws("|", "assignment_id", "doc_id", *span("span")), joined_key(c("question_batch_id"), c("question_id")), c("created"), "question"),
        Reference("submission_link", load(spark, d, "submission_link"), F.concat_ws("|", "submission_id", "doc_id", *span("span")), c("doc_id"), c("updated"), "document"),
        Reference("evaluation_batch", load(spark, d, "evaluation_batch"), c("id").cast("string"), c("sample_batch_id"), c("created"), "sample_batch"),
    ]
    parents = [
        Parent("submission", load(spark, d, "submission"), c("id"), c("updated")),
        Parent("question", load(spark, d, "evaluation_question"), joined_key(c("batch_id"), c("id")), c("created"), c("state") == "deleted"),
        Parent("document", load(spark, d, "document"), c("id"), c("updated")),
        Parent("sample_batch", load(spark, d, "sample_batch"), c("id"), c("created")),
    ]
    return orphans(references, parents)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Failing references per table, month and kind."""
    return orphan_report(p3_found(spark, d))


def _params(spark: SparkSession, d: str) -> DataFrame:
    """(source_table, record_key, v) of both tables with params."""
    q = load(spark, d, "evaluation_question").select(F.lit("evaluation_question").alias("source_table"), F.concat_ws("|", "batch_id", "id").alias("record_key"), "params")
    b = load(spark, d, "sample_batch").select(F.lit("sample_batch").alias("source_table"), F.col("id").cast("string").alias("record_key"), "params")
    return nested.documents(q.unionByName(b), ["source_table", "record_key"], "params")


def _objects(spark: SparkSession, d: str, values: bool = True) -> DataFrame:
    return nested.objects(_params(spark, d), ["source_table", "record_key"], values)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every JSON object below the top-level one, with the path of the object around it."""
    return _objects(spark, d, values=False).filter(F.col("parent_path").isNotNull()).select("source_table", "record_key", "path", "parent_path").distinct()


def p4_schema(spark: SparkSession, d: str) -> DataFrame:
    """The merged schema: kinds of value per structural path and field, with counts."""
    return nested.merged_schema(_objects(spark, d))


def p4_candidates(spark: SparkSession, d: str) -> DataFrame:
    """One of the flat tables: link candidates of a question's subject, with the key of the entity they belong to."""
    own = _objects(spark, d).filter("source_table = 'evaluation_question'")
    return nested.child_table(own, "evaluation_question", F.col("record_key"), "$.subject.entity.candidates[]", {"link": "string", "score": "double"})


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    """Every object of both tables' params with its surrogate key, its parent's, its ordinal and its values; each
    pattern is a flat table, the keys are those of `p4_candidates`."""
    return nested.rows(_objects(spark, d), F.col("source_table"), F.col("record_key"))


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """The keys of `p4_objects`: the row and the parent of each object, and its ordinals in the arrays between them."""
    o = _objects(spark, d, values=False)
    at = lambda p: nested.surrogate(F.col("source_table"), F.col("record_key"), F.col(p))
    return o.select("source_table", "record_key", nested.pattern(F.col("path")).alias("pattern"), at("path").alias("row_id"), at("parent_path").alias("parent_id"), F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ".").alias("ordinals"))


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables with their columns and types, as the merged schema has them."""
    own = nested.table_columns(_objects(spark, d))
    return spark.createDataFrame([(p, f, t) for p, fields in own.items() for f, t in (fields or {None: None}).items()], "pattern string, field string, type string")


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p4_found, p4_schema, p4_candidates, p4_objects, p4_rows, p4_tables)}

_P3 = """
WITH r AS (
 SELECT 'submission_sample' AS child_table, concat_ws('|', submission_id, doc_id, subject.lo, subject.hi, "object".lo, "object".hi, batch_id) AS record_key,
        CAST(submission_id AS VARCHAR) AS k, created AS ts, 'submission' AS p FROM submission_sample
 UNION ALL SELECT 'evaluation_mention_response', concat_ws('|', assignment_id, doc_id, span.lo, span.hi), question_batch_id || '|' || question_id, created, 'question' FROM evaluation_mention_response
 UNION ALL SELECT 'submission_link', concat_ws('|', submission_id, doc_id, span.lo, span.hi), doc_id, updated, 'document' FROM submission_link
 UNION ALL SELECT 'evaluation_batch', CAST(id AS VARCHAR), CAST(sample_batch_id AS VARCHAR), created, 'sample_batch' FROM evaluation_batch),
p AS (
 SELECT p, k, min(since) AS since, bool_and(gone) AS gone FROM (
  SELECT 'submission' AS p, CAST(id AS VARCHAR) AS k, updated AS since, false AS gone FROM submission
  UNION ALL SELECT 'question', batch_id || '|' || id, created, coalesce(state = 'deleted', false) FROM evaluation_question
  UNION ALL SELECT 'document', id, updated, false FROM document
  UNION ALL SELECT 'sample_batch', CAST(id AS VARCHAR), created, false FROM sample_batch) GROUP BY p, k),
f AS (
 SELECT DISTINCT child_table, record_key, r.k AS missing_key, strftime(ts, '%Y-%m') AS period,
        CASE WHEN p.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN since > ts THEN 'late' END AS kind
 FROM r LEFT JOIN p ON r.p = p.p AND r.k = p.k WHERE r.k IS NOT NULL)
"""
_P4 = """
WITH RECURSIVE src AS (
 SELECT DISTINCT 'evaluation_question' AS source_table, batch_id || '|' || id AS record_key, params FROM evaluation_question
 UNION SELECT DISTINCT 'sample_batch', CAST(id AS VARCHAR), params FROM sample_batch),
j1 AS (SELECT source_table, record_key, CAST(params AS JSON) AS j FROM src WHERE params IS NOT NULL AND json_valid(params)),
j2 AS (SELECT source_table, record_key, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS j FROM j1),
j3 AS (SELECT source_table, record_key, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS j FROM j2),
n(source_table, record_key, path, parent_path, j) AS (
 SELECT source_table, record_key, '$', '$', j FROM j3 WHERE j IS NOT NULL
 UNION ALL
 SELECT source_table, record_key, c.path, c.parent_path, c.j FROM n, LATERAL (
  SELECT n.path || '.' || f AS path, n.path AS parent_path, json_extract(n.j, '$."' || f || '"') AS j FROM (SELECT unnest(json_keys(n.j)) AS f) WHERE json_type(n.j) = 'OBJECT'
  UNION ALL
  SELECT n.path || '[' || i || ']', n.parent_path, json_extract(n.j, '$[' || i || ']') FROM (SELECT unnest(range(CAST(json_array_length(n.j) AS BIGINT))) AS i) WHERE json_type(n.j) = 'ARRAY') c
 WHERE json_type(c.j) IN ('OBJECT', 'ARRAY'))
"""
SQL = {
    "p3_found": _P3 + "SELECT * FROM f WHERE kind IS NOT NULL",
    "p3_report": _P3 + "SELECT child_table, period, kind, count(*) AS n_records, count(DISTINCT missing_key) AS n_keys FROM f WHERE kind IS NOT NULL GROUP BY ALL",
    "p4_schema": _P4 + """SELECT regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS pattern, f AS field, CASE json_type(x) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'DOUBLE' THEN 'DECIMAL' WHEN 'NULL' THEN 'VOID' ELSE json_type(x) END AS kind, count(*) AS n
 FROM (SELECT path, f, json_extract(j, '$."' || f || '"') AS x FROM (SELECT path, j, unnest(json_keys(j)) AS f FROM n WHERE json_type(j) = 'OBJECT')) GROUP BY ALL""",
    "p4_candidates": _P4 + """SELECT md5('evaluation_question|' || record_key || '|' || path) AS row_id, md5('evaluation_question|' || record_key || '|' || parent_path) AS parent_id, record_key, CAST(regexp_extract(path, '\\[(\\d+)\\]$', 1) AS INT) AS ordinal,
 j ->> '$.link' AS link, TRY_CAST(j ->> '$.score' AS DOUBLE) AS score FROM n WHERE source_table = 'evaluation_question' AND json_type(j) = 'OBJECT' AND regexp_full_match(path, '\\$\\.subject\\.entity\\.candidates\\[\\d+\\]')""",
    "p4_rows": _P4 + """SELECT source_table, record_key, regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS pattern, md5(source_table || '|' || record_key || '|' || path) AS row_id,
 CASE WHEN path <> '$' THEN md5(source_table || '|' || record_key || '|' || parent_path) END AS parent_id, CASE WHEN path <> '$' THEN array_to_string(regexp_extract_all(substr(path, length(parent_path) + 1), '\\[(\\d+)\\]', 1), '.') ELSE '' END AS ordinals FROM n WHERE json_type(j) = 'OBJECT'""",
    "p4_found": _P4 + "SELECT DISTINCT source_table, record_key, path, parent_path FROM n WHERE path <> '$' AND json_type(j) = 'OBJECT'",
}
