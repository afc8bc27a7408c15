"""Readers of knowledge-base files: tab-separated statements, entity-centric files, assessments, runs, XML documents.

Rows keep the number of their line, because the first definition of a key wins. Lines are numbered without a global
sort: the lines of each file block are counted, and the counts of the blocks before give the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions.dictionaries import ALIASES, ENTITY_TYPES, NER_TYPES, STRING_TYPES, lookup
from claimscope.functions.scalars import provenance

_TYPES = {t: t for t in (*ENTITY_TYPES, *STRING_TYPES)} | NER_TYPES


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 1 in each file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_m"))
    inner = raw.selectExpr("*", "row_number() OVER (PARTITION BY file, block ORDER BY _m) AS _n")
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_c")).selectExpr("file", "block", "sum(_c) OVER (PARTITION BY file ORDER BY block) - _c AS _off")
    return inner.join(blocks, ["file", "block"]).select("file", (F.col("_off") + F.col("_n")).alias("line"), "value")


def _provenances(text: Column, inclusive: bool = False) -> Column:
    """Comma-separated DOC:b-e as an array of structs; malformed parts are left out."""
    parts = F.transform(F.split(text, ","), lambda p: provenance(F.trim(p), inclusive))
    return F.when((text.isNotNull()) & (text != ""), F.filter(parts, lambda p: p.isNotNull())).otherwise(F.array().cast("array<struct<doc_id:string,lo:int,hi:int>>"))


def _columns(lines: DataFrame, n: int) -> DataFrame:
    cells = lines.filter(F.trim("value") != "").withColumn("c", F.split("value", "\t"))
    unquoted = lambda i: F.regexp_replace(F.get("c", F.lit(i)), r'^"(.*)"$', "$1")
    return cells.select("line", F.size("c").alias("n_columns"), *[unquoted(i).alias(f"c{i}") for i in range(n)])


def statements(lines: DataFrame, inclusive: bool = False) -> DataFrame:
    """Five-column statements as (line, kind, subject, relation, object, object_prov, provenances, weight): kind is
    mention, link, canonical, relation or, with the reason as relation, bad."""
    t = _columns(lines, 5)
    kind = F.when(F.col("n_columns") > 5, "bad").when(F.col("c1") == "link", "link").when(F.col("c1") == "canonical_mention", "canonical").when(lookup(_TYPES, F.col("c1")).isNotNull(), "mention").otherwise("relation")
    relation = F.when(F.col("n_columns") > 5, "E01").when(kind == "mention", lookup(_TYPES, F.col("c1"))).when(kind == "relation", lookup(ALIASES, F.col("c1"))).otherwise(F.col("c1"))
    return t.select("line", kind.alias("kind"), provenance(F.col("c0"), inclusive).alias("subject"), relation.alias("relation"), F.col("c2").alias("object"), provenance(F.col("c2"), inclusive).alias("object_prov"), _provenances(F.col("c3"), inclusive).alias("provenances"), F.coalesce(F.col("c4").try_cast("double"), F.lit(0.0)).alias("weight"))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    return statements(numbered_lines(spark, path))


def read_entity_statements(spark: SparkSession, path: str) -> DataFrame:
    return entity_statements(numbered_lines(spark, path))


def entity_statements(lines: DataFrame) -> DataFrame:
    """Entity-centric files: a header line, entity ids as subjects, inclusive ends. (line, kind, entity, relation,
    object, provenances, weight); kind is type, mention, canonical, relation or bad."""
    t = _columns(lines.filter("line > 1"), 5)
    kind = F.when(F.col("n_columns") > 5, "bad").when(F.col("c1") == "type", "type").when(F.col("c1") == "mention", "mention").when(F.col("c1") == "canonical_mention", "canonical").otherwise("relation")
    relation = F.when(kind == "relation", lookup(ALIASES, F.col("c1"))).otherwise(F.col("c1"))
    return t.select("line", kind.alias("kind"), F.col("c0").alias("entity"), relation.alias("relation"), F.col("c2").alias("object"), _provenances(F.col("c3"), True).alias("provenances"), F.coalesce(F.col("c4").try_cast("double"), F.lit(0.0)).alias("weight"))


def read_query_map(spark: SparkSession, path: str) -> DataFrame:
    return query_map(numbered_lines(spark, path))


def query_map(lines: DataFrame) -> DataFrame:
    """(query_id, other_id): the last line of an other_id wins."""
    t = lines.withColumn("c", F.split(F.trim("value"), r"\s+")).filter(F.size("c") >= 2)
    return t.groupBy(F.col("c")[1].alias("other_id")).agg(F.max_by(F.col("c")[0], F.col("line")).alias("query_id")).select("query_id", "other_id")


def read_gold(spark: SparkSession, path: str, queries: DataFrame, with_extra_column: bool = False) -> DataFrame:
    return gold(numbered_lines(spark, path), queries, with_extra_column)


def gold(lines: DataFrame, queries: DataFrame, with_extra_column: bool = False) -> DataFrame:
    """Assessments of eight columns (nine with one at position 6 to skip); equivalence class after the last ':'."""
    t = _columns(lines, 9)
    pick = [0, 1, 2, 3, 4, 5, 7, 8] if with_extra_column else list(range(8))
    c = [F.col(f"c{i}") for i in pick]
    rows = t.select(
        c[0].alias("id"), F.split_part(c[1], F.lit(":"), F.lit(1)).alias("other_id"), F.expr(f"substring(c{pick[1]}, instr(c{pick[1]}, ':') + 1)").alias("relation"), _provenances(c[2]).alias("relation_provenances"), c[3].alias("slot_value"), _provenances(c[4]).alias("slot_provenances"),
        c[5].alias("slot_value_label"), c[6].alias("relation_label"), F.coalesce(F.regexp_extract(c[7], r"(\d+)$", 1).try_cast("int"), F.lit(0)).alias("eq"),
    )
    return rows.join(queries, "other_id").drop("other_id")


def read_run(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    return run(numbered_lines(spark, path), queries)


def run(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """System runs of eight columns."""
    t = _columns(lines, 8)
    rows = t.select(F.col("c0").alias("other_id"), F.col("c1").alias("relation"), F.col("c2").alias("run_id"), _provenances(F.col("c3")).alias("relation_provenances"), F.col("c4").alias("slot_value"), F.col("c5").alias("slot_type"), _provenances(F.col("c6")).alias("slot_provenances"), F.col("c7").try_cast("double").alias("confidence"))
    return rows.join(queries, "other_id").drop("other_id")


# Fixed value: the line that begins XML files and isn't counted.
PROLOG = '<?xml version="1.0" encoding="utf-8"?>\n'


def documents_from_xml(files: DataFrame) -> DataFrame:
    """(path, value: whole XML) -> (id, title, doc_date, doc_length, doc_digest). The title is the headline or the
    first line of the text, white space collapsed; the date is DATE_TIME before 'T', in threads that of the first post,
    else eight digits of the id, else empty. The length leaves out the prolog and a final line break."""
    at = lambda p: F.xpath_string("value", F.lit(p))
    x = files.select("value", at("/*/@id").alias("id"), at("//HEADLINE").alias("headline"), at("//DATE_TIME").alias("stamp"), at("//post/@datetime").alias("posted"), at("//TEXT").alias("text"))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    title = F.when(F.trim("headline") != "", tidy(F.col("headline"))).otherwise(tidy(F.split_part(F.regexp_replace("text", r"^\s+", ""), F.lit("\n"), F.lit(1))))
    day = F.regexp_replace(F.regexp_extract("id", r"(\d{8})", 1), r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    before = lambda c: F.split_part(c, F.lit("T"), F.lit(1))
    date = F.when(F.trim("stamp") != "", before(F.trim("stamp"))).when(F.col("posted") != "", before(F.col("posted"))).otherwise(day)
    length = F.char_length("value") - F.when(F.startswith("value", F.lit(PROLOG)), len(PROLOG)).otherwise(0) - F.when(F.endswith("value", F.lit("\n")), 1).otherwise(0)
    return x.select("id", title.alias("title"), date.alias("doc_date"), length.alias("doc_length"), F.md5("value").alias("doc_digest"))


def queries_from_xml(files: DataFrame) -> DataFrame:
    """(value: whole XML) -> (query_id, gloss, mention_type, doc_id, lo, hi, slot): one row per query; ends are inclusive
    in the file."""
    q = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<query\b.*?</query>)"), F.lit(1))).alias("q"))
    at = lambda p: F.xpath_string("q", F.lit(f"/query/{p}"))
    return q.select(at("@id").alias("query_id"), at("name").alias("gloss"), F.upper(at("enttype")).alias("mention_type"), at("docid").alias("doc_id"), at("beg").try_cast("int").alias("lo"), (at("end").try_cast("int") + 1).alias("hi"), at("slot0").alias("slot"))


# States of assignments outside, and inside.
STATES = {"Submitted": "pending-extraction", "Rejected": "rejected", "Approved": "approved", "error": "error"}


def assignments_from_xml(rows: DataFrame) -> DataFrame:
    """(assignment_id, hit_id, worker_id, answer: XML, status) -> the fields of each answer and its state inside. Where
    the response is missing the state is an error, the response `{}` and the time -1."""
    parts = F.regexp_extract_all("answer", F.lit(r"(?s)(<Answer>.*?</Answer>)"), F.lit(1))
    field = lambda a, n: F.xpath_string(a, F.lit(f"/Answer/{n}"))
    pairs = F.transform(parts, lambda a: F.struct(field(a, "QuestionIdentifier"), field(a, "FreeText")))
    x = rows.withColumn("f", F.map_from_entries(pairs))
    get = lambda n: F.nullif(F.try_element_at("f", F.lit(n)), F.lit(""))
    ok = get("response").isNotNull()
    return x.select(
        "assignment_id", "hit_id", "worker_id", F.when(ok, get("workerTime").try_cast("double")).otherwise(-1.0).alias("worker_time"), get("comment").alias("comments"),
        F.when(ok, lookup(STATES, F.col("status"))).otherwise("error").alias("state"), F.coalesce(get("response"), F.lit("{}")).alias("response"),
    )


def legacy_answers(lines: DataFrame) -> DataFrame:
    """Tables of earlier batches: a header line names the columns of its file; missing units and rewards are -1."""
    cells = lines.withColumn("c", F.split("value", "\t"))
    names = cells.filter("line = 1").select("file", F.col("c").alias("names"))
    named = cells.filter("line > 1 AND value <> ''").join(names, "file").select("file", "line", F.map_from_arrays("names", F.slice("c", F.lit(1), F.size("names"))).alias("m"))
    get = lambda n: F.try_element_at("m", F.lit(n))
    return named.select("file", "line", get("HITId").alias("hit_id"), get("workerId").alias("worker_id"), get("assignmentId").alias("assignment_id"), get("doc_id").alias("doc_id"), get("timeTaken").alias("time_taken"), F.coalesce(get("units").try_cast("double"), F.lit(-1.0)).alias("units"), F.coalesce(get("reward").try_cast("double"), F.lit(-1.0)).alias("reward"))
