"""Queries of joins, aggregates, deduplication, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions import dictionaries as dic
from claimscope.functions import scalars as sc
from claimscope.operators import audits, nested, ranges, views
from claimscope.operators.ordering import distinct_on, keep_newest, latest, mode_with_nulls, top, unordered
from claimscope.sources import derived as k
from claimscope.sources.derived import sql
from claimscope.tables import load

QUERIES, SQL = {}, {}


def query(body: str | None = None, *with_views: str, more: str = ""):
    """Register a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = sql(body, *with_views, more=more) if with_views or more else body
        return f

    return add


_STAT = """st AS (SELECT submission_id, subject_entity, relation, CASE WHEN min(object_type) IN ('PER', 'ORG', 'GPE') THEN object_entity ELSE 'STRING' END AS object_entity, count(*) AS n
 FROM k_relation r GROUP BY submission_id, subject_entity, relation, r.object_entity)"""


@query("SELECT submission_id, subject_entity, relation, object_entity, n FROM st", "k_relation", more=_STAT)
def stat_counts(s: SparkSession, d: str) -> DataFrame:
    return views.statistics(k.relations(s, d))


@query("SELECT submission_id, relation, CAST(sum(n) AS BIGINT) AS n FROM st GROUP BY ALL", "k_relation", more=_STAT)
def rel_counts(s: SparkSession, d: str) -> DataFrame:
    return views.relation_counts(stat_counts(s, d))


@query("SELECT submission_id, subject_entity, CAST(sum(n) AS BIGINT) AS n FROM st GROUP BY ALL", "k_relation", more=_STAT)
def ent_counts(s: SparkSession, d: str) -> DataFrame:
    return views.entity_counts(stat_counts(s, d))


@query("SELECT submission_id, subject_entity, count(DISTINCT object_entity) AS n FROM st GROUP BY ALL", "k_relation", more=_STAT)
def ent_rel_distinct(s: SparkSession, d: str) -> DataFrame:
    return views.entity_relation_counts(stat_counts(s, d))


@query("""SELECT m.submission_id, m.doc_id, m.lo, m.hi, m.mention_type, m.gloss, m.c_lo, m.c_hi,
 CASE WHEN n.mention_type = 'DATE' THEN 'date:' || n.gloss ELSE 'gloss:' || n.gloss END AS canonical_gloss,
 CASE WHEN n.mention_type = 'TITLE' THEN 'gloss:' || n.gloss WHEN n.mention_type = 'DATE' THEN coalesce(l.link_name, 'date:' || n.gloss) ELSE coalesce(l.link_name, 'gloss:' || n.gloss) END AS entity
 FROM m JOIN m n ON m.submission_id = n.submission_id AND m.doc_id = n.doc_id AND m.c_lo = n.lo AND m.c_hi = n.hi
 LEFT JOIN l ON m.submission_id = l.submission_id AND m.doc_id = l.doc_id AND m.c_lo = l.lo AND m.c_hi = l.hi""", "m", "l")
def mention_link(s: SparkSession, d: str) -> DataFrame:
    return views.mention_link(k.latest_mentions(s, d), k.latest_links(s, d))


_REL = """er AS (SELECT r.submission_id, r.doc_id, r.subject_lo, r.subject_hi, r.object_lo, r.object_hi, r.relation, r.subject_entity, r.confidence,
 a.mention_type AS subject_mention_type, la.link_name AS subject_link, b.mention_type AS object_mention_type, lb.link_name AS object_link
 FROM k_relation r
 JOIN k_mention a ON r.submission_id = a.submission_id AND r.doc_id = a.doc_id AND r.subject_lo = a.lo AND r.subject_hi = a.hi
 LEFT JOIN k_link la ON a.submission_id = la.submission_id AND a.doc_id = la.doc_id AND a.lo = la.lo AND a.hi = la.hi
 JOIN k_mention b ON r.submission_id = b.submission_id AND r.doc_id = b.doc_id AND r.object_lo = b.lo AND r.object_hi = b.hi
 LEFT JOIN k_link lb ON b.submission_id = lb.submission_id AND b.doc_id = lb.doc_id AND b.lo = lb.lo AND b.hi = lb.hi)"""
_REL_COLUMNS = ["submission_id", "doc_id", "subject_lo", "subject_hi", "object_lo", "object_hi", "relation", "subject_entity", "confidence", "subject_mention_type", "subject_link", "object_mention_type", "object_link"]


@query("SELECT * REPLACE (round(confidence, 6) AS confidence) FROM er", "k_relation", "k_mention", "k_link", more=_REL)
def entity_relation(s: SparkSession, d: str) -> DataFrame:
    return _entity_relation(s, d).withColumn("confidence", F.round("confidence", 6))


def _entity_relation(s: SparkSession, d: str) -> DataFrame:
    return views.entity_relation(k.relations(s, d), k.mentions(s, d), k.links(s, d)).select(*_REL_COLUMNS)


@query("""SELECT a.submission_id, a.doc_id, a.lo, a.hi, mention_type, link_name FROM k_mention a LEFT JOIN k_link l
 ON a.submission_id = l.submission_id AND a.doc_id = l.doc_id AND a.lo = l.lo AND a.hi = l.hi WHERE NOT (mention_type = 'TITLE' AND starts_with(link_name, 'wiki:'))""", "k_mention", "k_link")
def gold_mention_link_3vl(s: SparkSession, d: str) -> DataFrame:
    return views.gold_mention_link(k.mentions(s, d), k.links(s, d), ["submission_id", "doc_id", "lo", "hi"]).select("submission_id", "doc_id", "lo", "hi", "mention_type", "link_name")


_GOLD = """g AS (SELECT doc_id, subject_lo, object_lo, relation, correct, CASE WHEN relation LIKE 'org:%' THEN 'ORG' ELSE 'PER' END AS g_type,
 CASE WHEN (doc_id + subject_lo) % 5 = 0 THEN NULL ELSE 'wiki:E' || ((doc_id + subject_lo) % 97) END AS g_link FROM k_gold),
en AS (SELECT er.*, g.relation AS gold_relation, g.correct AS gold_correct, subject_mention_type = g_type AS type_match,
 (subject_link = g_link) OR (subject_entity = g_link) AS entity_match, er.relation = g.relation AS relation_match FROM er JOIN g USING (doc_id, subject_lo, object_lo))"""


def _entries(s: SparkSession, d: str) -> DataFrame:
    gold = k.gold(s, d).selectExpr("*", "CASE WHEN relation LIKE 'org:%' THEN 'ORG' ELSE 'PER' END AS g_subject_type", "CASE WHEN (doc_id + subject_lo) % 5 = 0 THEN NULL ELSE concat('wiki:E', (doc_id + subject_lo) % 97) END AS g_subject_link")
    return views.entries_list(_entity_relation(s, d), gold)


@query("SELECT submission_id, doc_id, subject_lo, object_lo, relation, gold_relation, gold_correct, type_match, entity_match, relation_match FROM en", "k_relation", "k_mention", "k_link", "k_gold", more=_REL + ",\n" + _GOLD)
def entries_list(s: SparkSession, d: str) -> DataFrame:
    return _entries(s, d).select("submission_id", "doc_id", "subject_lo", "object_lo", "relation", "gold_relation", "gold_correct", "type_match", "entity_match", "relation_match")


@query("""SELECT submission_id, doc_id, subject_lo, subject_hi, object_lo, object_hi, type_match, entity_match, entity_correct, predicate_correct, entity_correct AND predicate_correct AS correct FROM e2
 QUALIFY row_number() OVER (PARTITION BY submission_id, doc_id, subject_lo, subject_hi, object_lo, object_hi ORDER BY type_match DESC NULLS FIRST, entity_match DESC NULLS FIRST, entity_correct ASC NULLS LAST,
 gold_relation NULLS LAST, subject_link NULLS LAST, object_link NULLS LAST, relation NULLS LAST, confidence NULLS LAST) = 1""", "k_relation", "k_mention", "k_link", "k_gold",
       more=_REL + ",\n" + _GOLD + ",\ne2 AS (SELECT *, CASE WHEN type_match AND entity_match THEN gold_correct END AS entity_correct, CASE WHEN type_match THEN relation_match END AS predicate_correct FROM en)")
def entries_best_match(s: SparkSession, d: str) -> DataFrame:
    keys = ["submission_id", "doc_id", "subject_lo", "subject_hi", "object_lo", "object_hi"]
    return views.best_entries(_entries(s, d), keys).select(*keys, "type_match", "entity_match", "entity_correct", "predicate_correct", "correct")


def _sentences(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "sentence").selectExpr("doc_id", "span.lo AS o_lo", "span.hi AS o_hi", "sentence_index").distinct()


@query("SELECT m.submission_id, m.doc_id, m.lo, m.hi, s.lo AS sentence_lo, s.hi AS sentence_hi FROM m JOIN s ON m.doc_id = s.doc_id AND s.lo <= m.lo AND m.hi <= s.hi AND m.lo < m.hi", "m", "s")
def sentence_containment(s: SparkSession, d: str) -> DataFrame:
    j = ranges.contained_in(k.latest_mentions(s, d).select("submission_id", "doc_id", "lo", "hi"), _sentences(s, d), ["doc_id"])
    return j.select("submission_id", "doc_id", "lo", "hi", F.col("o_lo").alias("sentence_lo"), F.col("o_hi").alias("sentence_hi"))


_SAMPLE = "p AS (SELECT DISTINCT submission_id, doc_id, subject.lo AS s_lo, subject.hi AS s_hi, \"object\".lo AS b_lo, \"object\".hi AS b_hi FROM submission_sample)"


def _samples(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "submission_sample").selectExpr("submission_id", "doc_id", "subject.lo AS s_lo", "subject.hi AS s_hi", "object.lo AS b_lo", "object.hi AS b_hi").distinct()


@query("SELECT p.*, s.lo AS sentence_lo, s.hi AS sentence_hi FROM p JOIN s ON p.doc_id = s.doc_id AND s.lo <= least(s_lo, b_lo) AND greatest(s_hi, b_hi) <= s.hi", "s", more=_SAMPLE)
def both_args_in_sentence(s: SparkSession, d: str) -> DataFrame:
    p = _samples(s, d).withColumns({"lo": F.least("s_lo", "b_lo"), "hi": F.greatest("s_hi", "b_hi")})
    j = ranges.contained_in(p, _sentences(s, d), ["doc_id"])
    return j.select("submission_id", "doc_id", "s_lo", "s_hi", "b_lo", "b_hi", F.col("o_lo").alias("sentence_lo"), F.col("o_hi").alias("sentence_hi"))


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in dic.pair_types())


@query(f"""SELECT submission_id, doc_id, a_lo, a_hi, b_lo, b_hi FROM (
 SELECT x.submission_id, x.doc_id, x.lo AS a_lo, x.hi AS a_hi, y.lo AS b_lo, y.hi AS b_hi FROM i x JOIN i y ON x.submission_id = y.submission_id AND x.doc_id = y.doc_id AND x.sentence_lo = y.sentence_lo AND x.sentence_hi = y.sentence_hi
 WHERE (x.lo, x.hi) <> (y.lo, y.hi) AND (x.c_lo, x.c_hi) <> (y.c_lo, y.c_hi) AND (x.mention_type, y.mention_type) IN ({_PAIRS}))
 QUALIFY row_number() OVER (PARTITION BY submission_id, doc_id, least(row(a_lo, a_hi), row(b_lo, b_hi)), greatest(row(a_lo, a_hi), row(b_lo, b_hi)) ORDER BY a_lo, a_hi, b_lo, b_hi) = 1""", "m", "s",
       more="i AS (SELECT m.submission_id, m.doc_id, m.lo, m.hi, m.c_lo, m.c_hi, m.mention_type, s.lo AS sentence_lo, s.hi AS sentence_hi FROM m JOIN s ON m.doc_id = s.doc_id AND s.lo <= m.lo AND m.hi <= s.hi AND m.lo < m.hi)")
def mention_pairs(s: SparkSession, d: str) -> DataFrame:
    m = k.latest_mentions(s, d).select("submission_id", "doc_id", "lo", "hi", "c_lo", "c_hi", "mention_type")
    x = ranges.contained_in(m, _sentences(s, d).drop("sentence_index").distinct(), ["doc_id"]).withColumn("span", F.struct("lo", "hi")).withColumn("canon", F.struct("c_lo", "c_hi"))
    key = ["submission_id", "doc_id", "o_lo", "o_hi"]
    a = x.select(*key, F.col("span").alias("a"), F.col("canon").alias("ca"), F.col("mention_type").alias("ta"))
    b = x.select(*key, F.col("span").alias("b"), F.col("canon").alias("cb"), F.col("mention_type").alias("tb"))
    kinds = F.concat_ws(">", "ta", "tb").isin(*[f"{p}>{q}" for p, q in dic.pair_types()])
    pairs = a.join(b, key).filter((F.col("a") != F.col("b")) & (F.col("ca") != F.col("cb")) & kinds)
    return unordered(pairs, F.col("a"), F.col("b"), ["submission_id", "doc_id"], [F.col("a"), F.col("b")]).select("submission_id", "doc_id", F.col("a.lo").alias("a_lo"), F.col("a.hi").alias("a_hi"), F.col("b.lo").alias("b_lo"), F.col("b.hi").alias("b_hi"))


@query("""SELECT r.doc_id, r.mention_type, r.lo, r.hi, max(least(r.hi, u.hi) - greatest(r.lo, u.lo)) AS longest FROM (SELECT DISTINCT doc_id, mention_type, lo, hi FROM r) r
 JOIN (SELECT DISTINCT doc_id, mention_type, lo, hi FROM m) u ON r.doc_id = u.doc_id AND r.mention_type = u.mention_type AND r.lo < u.hi AND u.lo < r.hi AND u.lo < u.hi AND r.lo < r.hi GROUP BY ALL""", "r", "m")
def overlap_longest(s: SparkSession, d: str) -> DataFrame:
    r = k.responses(s, d).select("doc_id", "mention_type", "lo", "hi").distinct()
    m = k.latest_mentions(s, d).select("doc_id", "mention_type", F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi")).distinct()
    j = ranges.overlapping(r, m, ["doc_id", "mention_type"])
    return j.groupBy("doc_id", "mention_type", "lo", "hi").agg(F.max(ranges.overlap_length(*map(F.col, ("lo", "hi", "o_lo", "o_hi")))).alias("longest"))


@query("""SELECT p.submission_id, p.doc_id, p.s_lo, p.s_hi, min(m.lo) AS next_lo FROM p LEFT JOIN m ON p.submission_id = m.submission_id AND p.doc_id = m.doc_id AND m.lo >= p.s_lo GROUP BY ALL""", "m",
       more="p AS (SELECT DISTINCT submission_id, doc_id, subject.lo AS s_lo, subject.hi AS s_hi FROM submission_sample)")
def first_mention_after(s: SparkSession, d: str) -> DataFrame:
    points = _samples(s, d).select("submission_id", "doc_id", "s_lo", "s_hi").distinct()
    spans = k.latest_mentions(s, d).select("submission_id", "doc_id", "lo", "hi")
    return ranges.next_at_or_after(points, spans, ["submission_id", "doc_id"], "s_lo", "lo", ["hi"]).select("submission_id", "doc_id", "s_lo", "s_hi", "next_lo")


@query("""SELECT r.assignment_id, r.doc_id, r.lo, r.hi, q.state, b.batch_type, sb.distribution_type, u.name AS submission FROM r
 LEFT JOIN (SELECT DISTINCT batch_id, id, state FROM evaluation_question) q ON r.question_batch_id = q.batch_id AND r.question_id = q.id
 LEFT JOIN (SELECT DISTINCT id, batch_type, sample_batch_id FROM evaluation_batch) b ON q.batch_id = b.id
 LEFT JOIN (SELECT DISTINCT id, distribution_type, submission_id FROM sample_batch) sb ON b.sample_batch_id = sb.id
 LEFT JOIN submission u ON sb.submission_id = u.id""", "r")
def response_flat(s: SparkSession, d: str) -> DataFrame:
    q = load(s, d, "evaluation_question").select(F.col("batch_id").alias("question_batch_id"), F.col("id").alias("question_id"), "state").distinct()
    b = load(s, d, "evaluation_batch").select(F.col("id").alias("b_id"), "batch_type", "sample_batch_id").distinct()
    sb = load(s, d, "sample_batch").select(F.col("id").alias("sample_batch_id"), "distribution_type", "submission_id").distinct()
    u = load(s, d, "submission").select(F.col("id").alias("submission_id"), F.col("name").alias("submission"))
    j = k.responses(s, d).join(q, ["question_batch_id", "question_id"], "left").withColumn("b_id", F.when(F.col("state").isNotNull(), F.col("question_batch_id")))
    return j.join(b, "b_id", "left").join(sb, "sample_batch_id", "left").join(u, "submission_id", "left").select("assignment_id", "doc_id", "lo", "hi", "state", "batch_type", "distribution_type", "submission")


@query("""SELECT d.corpus_tag, d.n_docs, coalesce(c.n_entities, 0) AS n_entities FROM (SELECT corpus_tag, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY corpus_tag) d
 LEFT JOIN (SELECT corpus_tag, count(DISTINCT kb_entity) AS n_entities FROM documents WHERE kb_entity IS NOT NULL GROUP BY corpus_tag) c ON d.corpus_tag = c.corpus_tag""")
def corpus_listing(s: SparkSession, d: str) -> DataFrame:
    t = load(s, d, "documents")
    a = t.groupBy("corpus_tag").agg(F.countDistinct("doc_id").alias("n_docs"))
    b = t.filter(F.col("kb_entity").isNotNull()).groupBy("corpus_tag").agg(F.countDistinct("kb_entity").alias("n_entities"))
    return a.join(b, "corpus_tag", "left").select("corpus_tag", "n_docs", F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


#: Names with their words and their runs of scripts without spaces, documents with their words; a name matches where all of
#: its words are the document's and all of its runs are in the text.
_U0 = "\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Thai}\\p{Lao}\\p{Khmer}\\p{Myanmar}\\x{30FC}\\x{3099}\\x{309A}\\x{FF70}\\x{FF9E}\\x{FF9F}"
MATCHES = f"""n0 AS (SELECT DISTINCT kb_entity AS query, lower(regexp_replace(kb_entity, '^wiki:|_\\([^)]*\\)$', '', 'g')) AS name FROM documents WHERE kb_entity IS NOT NULL),
tx AS (SELECT DISTINCT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL),
pn AS (SELECT query, list_filter(regexp_extract_all(name, '[{_U0}]+|[^{_U0}]+'), lambda x: true) AS parts FROM n0),
nw AS (SELECT query, list_distinct(flatten(list_transform(list_filter(parts, lambda x: NOT regexp_matches(x, '^[{_U0}]')), lambda x: regexp_extract_all(x, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')))) AS words,
 list_distinct(flatten(list_transform(list_filter(parts, lambda x: regexp_matches(x, '^[{_U0}]')), lambda x: regexp_extract_all(x, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')))) AS runs FROM pn),
tw AS (SELECT DISTINCT doc_id, unnest(flatten(list_transform(list_filter(regexp_extract_all(text, '[{_U0}]+|[^{_U0}]+'), lambda x: NOT regexp_matches(x, '^[{_U0}]')), lambda x: regexp_extract_all(x, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')))) AS token FROM tx),
wm AS (SELECT q.query, t.doc_id FROM (SELECT query, unnest(words) AS token, len(words) AS n FROM nw) q JOIN tw t USING (token) GROUP BY q.query, t.doc_id, q.n HAVING count(*) = q.n),
mt AS (SELECT wm.query, wm.doc_id FROM wm JOIN nw USING (query) JOIN tx USING (doc_id) WHERE list_bool_and(list_transform(runs, lambda r: contains(text, r))) IS NOT FALSE
 UNION SELECT nw.query, tx.doc_id FROM nw JOIN tx ON contains(text, runs[1]) WHERE len(words) = 0 AND len(runs) > 0 AND list_bool_and(list_transform(runs, lambda r: contains(text, r))))"""


@query("SELECT query, doc_id FROM mt", more=MATCHES)
def text_match(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold every lexeme of an entity's name, in any script; only lexemes of some name are shuffled.
    A lexeme is a run of letters, marks and digits. Scripts written without spaces have no borders of words: there, a
    run counts wherever the text holds it. Its pairs of characters find the documents, whose texts are then searched."""
    t = load(s, d, "documents")
    name = F.lower(F.regexp_replace("query", r"^wiki:|_\([^)]*\)$", ""))
    q = t.select(F.col("kb_entity").alias("query")).dropna().distinct().select("query", sc.lexemes(name, singles=False).alias("t"), sc.unspaced_runs(name).alias("runs"))
    q = q.select("query", F.size("t").alias("n"), F.filter("runs", lambda r: F.char_length(r) > 2).alias("runs"), F.explode("t").alias("token"))
    texts = t.filter(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("text"))
    w = texts.select("doc_id", F.explode(sc.lexemes(F.col("text"))).alias("token")).join(q.select("token").distinct(), "token", "left_semi").distinct()
    hits = q.join(w, "token").groupBy("query", "doc_id", "n", "runs").agg(F.count(F.lit(1)).alias("hits")).filter("hits = n")
    sure, doubtful = hits.filter("size(runs) = 0"), hits.filter("size(runs) > 0").join(texts.filter(F.col("text").rlike(sc.UNSPACED)), "doc_id").filter("forall(runs, r -> contains(text, r))")
    return sure.select("query", "doc_id").union(doubtful.select("query", "doc_id"))


#: Questions whose payload is an object, also where it is a JSON string that holds it, once or twice.
OPENED = """o1 AS (SELECT batch_id, id, CAST(params AS JSON) AS j FROM evaluation_question WHERE json_valid(params)),
o2 AS (SELECT batch_id, id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS j FROM o1),
o3 AS (SELECT batch_id, id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS j FROM o2),
oq AS (SELECT DISTINCT batch_id, id, CAST(j AS VARCHAR) AS params FROM o3 WHERE json_type(j) = 'OBJECT')"""
_ASKED = OPENED + """,
qs AS (SELECT DISTINCT coalesce(json_extract_string(params, '$.doc_id'), json_extract_string(params, '$.mention_1[0]')) AS doc_id, TRY_CAST(coalesce(json_extract_string(params, '$.subject.span[0]'), json_extract_string(params, '$.mention_1[1]')) AS INT) AS x,
 TRY_CAST(coalesce(json_extract_string(params, '$.object.span[0]'), json_extract_string(params, '$.mention_2[1]')) AS INT) AS y FROM oq)"""


@query("""SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM qs WHERE qs.doc_id = p.doc_id AND qs.x = p.s_lo AND qs.y = p.b_lo) AND NOT EXISTS (SELECT 1 FROM qs WHERE qs.doc_id = p.doc_id AND qs.x = p.b_lo AND qs.y = p.s_lo)""", more=_SAMPLE + ",\n" + _ASKED)
def unasked_samples(s: SparkSession, d: str) -> DataFrame:
    """Samples whose pair no question asks about in either direction, whatever the shape of its payload."""
    at = lambda p: F.get_json_object("params", p)
    lo = lambda role, legacy: F.coalesce(at(f"$.{role}.span[0]"), at(f"$.{legacy}[1]")).try_cast("int")
    valid = nested.with_object(load(s, d, "evaluation_question"), "params")
    asked = valid.select(F.coalesce(at("$.doc_id"), at("$.mention_1[0]")).alias("doc_id"), lo("subject", "mention_1").alias("x"), lo("object", "mention_2").alias("y")).dropna().distinct()
    both = asked.unionByName(asked.select("doc_id", F.col("y").alias("x"), F.col("x").alias("y"))).select("doc_id", F.col("x").alias("s_lo"), F.col("y").alias("b_lo")).distinct()
    return _samples(s, d).join(both, ["doc_id", "s_lo", "b_lo"], "left_anti").select("submission_id", "doc_id", "s_lo", "s_hi", "b_lo", "b_hi")


@query("SELECT submission_id, doc_id, lo, hi FROM m SEMI JOIN document d ON m.doc_id = d.id", "m")
def mentions_in_corpus(s: SparkSession, d: str) -> DataFrame:
    return k.latest_mentions(s, d).select("submission_id", "doc_id", "lo", "hi").join(load(s, d, "document").select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("submission_id", "doc_id", "lo", "hi")


@query("SELECT DISTINCT m.submission_id, u.corpus_tag, m.doc_id FROM m JOIN submission u ON m.submission_id = u.id", "m")
def submission_documents(s: SparkSession, d: str) -> DataFrame:
    m, u = k.latest_mentions(s, d).select("submission_id", "doc_id").distinct(), load(s, d, "submission").select(F.col("id").alias("submission_id"), "corpus_tag")
    return m.join(u, "submission_id").select("submission_id", "corpus_tag", "doc_id")


# aggregates


@query("""SELECT doc_id, lo, hi, mention_type AS mode FROM (SELECT doc_id, lo, hi, mention_type, count(*) AS n FROM r GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY doc_id, lo, hi ORDER BY n DESC, mention_type NULLS LAST) = 1""", "r")
def mode_det(s: SparkSession, d: str) -> DataFrame:
    return mode_with_nulls(k.responses(s, d), ["doc_id", "lo", "hi"], "mention_type")


@query("""SELECT doc_id, lo, hi, gloss AS mode FROM (SELECT doc_id, lo, hi, gloss, count(*) AS n FROM r WHERE gloss IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, lo, hi ORDER BY n DESC, gloss) = 1""", "r")
def mode_ignoring_nulls(s: SparkSession, d: str) -> DataFrame:
    return mode_with_nulls(k.responses(s, d).filter(F.col("gloss").isNotNull()), ["doc_id", "lo", "hi"], "gloss")


@query("SELECT doc_id, min_by(gloss, row(created, assignment_id, lo, hi)) AS first_gloss, max_by(gloss, row(created, assignment_id, lo, hi)) AS last_gloss FROM r WHERE gloss IS NOT NULL GROUP BY doc_id", "r")
def first_last(s: SparkSession, d: str) -> DataFrame:
    g = k.responses(s, d).filter(F.col("gloss").isNotNull())
    key = F.struct("created", "assignment_id", "lo", "hi")
    return g.groupBy("doc_id").agg(F.min_by("gloss", key).alias("first_gloss"), F.max_by("gloss", key).alias("last_gloss"))


@query("SELECT doc_id, lo, hi, len(list(gloss)) AS n_with_nulls, count(gloss) AS n FROM r GROUP BY ALL", "r")
def array_keep_nulls(s: SparkSession, d: str) -> DataFrame:
    g = k.responses(s, d).groupBy("doc_id", "lo", "hi").agg(F.collect_list(F.struct("gloss")).alias("a"), F.count("gloss").alias("n"))
    return g.select("doc_id", "lo", "hi", F.size(F.transform("a", lambda x: x.gloss)).cast("long").alias("n_with_nulls"), "n")


@query("SELECT doc_id, lo, hi, array_to_string(list_sort(list(DISTINCT question_id)), ',') AS question_ids, array_to_string(list_sort(list(DISTINCT question_batch_id)), ',') AS batch_ids FROM r GROUP BY ALL", "r")
def array_distinct_ids(s: SparkSession, d: str) -> DataFrame:
    g = k.responses(s, d).groupBy("doc_id", "lo", "hi").agg(F.array_sort(F.collect_set("question_id")).alias("q"), F.array_sort(F.collect_set("question_batch_id")).alias("b"))
    return g.select("doc_id", "lo", "hi", F.array_join("q", ",").alias("question_ids"), F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("batch_ids"))


@query("SELECT worker_id, CAST(quantile_disc(hi - lo, 0.5) AS DOUBLE) AS median_length, round(avg(hi - lo), 6) AS mean_length, round(stddev_samp(hi - lo), 6) AS sd FROM r GROUP BY worker_id", "r")
def length_statistics(s: SparkSession, d: str) -> DataFrame:
    g = k.responses(s, d).withColumn("len", F.col("hi") - F.col("lo"))
    return g.groupBy("worker_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY len)").cast("double").alias("median_length"), F.round(F.avg("len"), 6).alias("mean_length"), F.round(F.stddev_samp("len"), 6).alias("sd"))


@query("SELECT batch_id, state, count(*) AS n FROM (SELECT DISTINCT batch_id, id, state FROM evaluation_question) GROUP BY ALL")
def status_histogram(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "evaluation_question").select("batch_id", "id", "state").distinct().groupBy("batch_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT relation, count(DISTINCT subject_entity) AS entities, count(DISTINCT object_entity) AS fills, count(DISTINCT (subject_entity, object_entity)) AS instances FROM k_relation GROUP BY relation", "k_relation")
def distinct_counts(s: SparkSession, d: str) -> DataFrame:
    return k.relations(s, d).groupBy("relation").agg(F.countDistinct("subject_entity").alias("entities"), F.countDistinct("object_entity").alias("fills"), F.countDistinct("subject_entity", "object_entity").alias("instances"))


@query("SELECT worker_id, count(*) AS n, count(CASE WHEN weight = 1 THEN 1 END) AS yes, sum(CASE WHEN weight = 0 THEN 1 ELSE 0 END)::BIGINT AS no FROM k_vote GROUP BY worker_id", "k_vote")
def conditional_counts(s: SparkSession, d: str) -> DataFrame:
    return k.votes(s, d).groupBy("worker_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("weight") == 1).alias("yes"), F.count_if(F.col("weight") == 0).alias("no"))


@query("SELECT relation, array_to_string(list_sort(list(DISTINCT subject_entity)), ' ') AS entities FROM k_relation GROUP BY relation", "k_relation")
def inverted(s: SparkSession, d: str) -> DataFrame:
    return k.relations(s, d).groupBy("relation").agg(F.array_join(F.array_sort(F.collect_set("subject_entity")), " ").alias("entities"))


# order and sets


@query("SELECT doc_id, lo, hi, mention_type, gloss FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, lo, hi ORDER BY submission_id) = 1", "m")
def first_of_span(s: SparkSession, d: str) -> DataFrame:
    return distinct_on(k.latest_mentions(s, d), ["doc_id", "lo", "hi"], [F.col("submission_id")]).select("doc_id", "lo", "hi", "mention_type", "gloss")


@query("SELECT doc_id, s_lo, b_lo FROM (SELECT DISTINCT doc_id, s_lo, b_lo FROM p) QUALIFY row_number() OVER (PARTITION BY doc_id, least(s_lo, b_lo), greatest(s_lo, b_lo) ORDER BY s_lo, b_lo) = 1", more=_SAMPLE)
def unordered_pairs(s: SparkSession, d: str) -> DataFrame:
    p = _samples(s, d).select("doc_id", "s_lo", "b_lo").distinct()
    return unordered(p, F.col("s_lo"), F.col("b_lo"), ["doc_id"], [F.col("s_lo"), F.col("b_lo")])


@query("""SELECT user_id, value, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_type DESC) = 1 ORDER BY value DESC, user_id LIMIT 20""")
def leaderboard_latest(s: SparkSession, d: str) -> DataFrame:
    return top(latest(load(s, d, "events"), ["user_id"], "ts", ["value", "event_type"]).drop("ts"), [F.col("value").desc(), F.col("user_id")], 20)


@query("SELECT submission_id, relation, n, rank() OVER (PARTITION BY submission_id ORDER BY n DESC) AS rank FROM (SELECT submission_id, relation, count(*) AS n FROM k_relation GROUP BY ALL)", "k_relation")
def ranked_relations(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = k.relations(s, d).groupBy("submission_id", "relation").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.rank().over(Window.partitionBy("submission_id").orderBy(F.desc("n"))))


@query("SELECT assignment_id, question_id, row_number() OVER (PARTITION BY question_id ORDER BY created DESC NULLS LAST, assignment_id DESC) > 50 AS ignored FROM k_vote", "k_vote")
def newest_k(s: SparkSession, d: str) -> DataFrame:
    return keep_newest(k.votes(s, d), ["question_id"], "created", "assignment_id", F.lit(50)).select("assignment_id", "question_id", "ignored")


@query("""SELECT DISTINCT doc_id, relation FROM (SELECT doc_id, relation, abs(2 - abs(subject_lo - object_hi)) AS a, abs(2 - abs(object_lo - subject_hi)) AS b, confidence, subject_entity, object_entity FROM k_relation)
 QUALIFY row_number() OVER (PARTITION BY doc_id, relation ORDER BY least(a, b)) = 1""", "k_relation")
def nearest_instance(s: SparkSession, d: str) -> DataFrame:
    r = k.relations(s, d)
    near = F.least(F.abs(2 - F.abs(F.col("subject_lo") - F.col("object_hi"))), F.abs(2 - F.abs(F.col("object_lo") - F.col("subject_hi"))))
    return distinct_on(r.withColumn("near", near), ["doc_id", "relation"], [F.col("near"), F.col("confidence"), F.col("subject_lo"), F.col("object_lo")]).select("doc_id", "relation")


@query("SELECT question_batch_id AS batch_id, question_id FROM r UNION SELECT batch_id, id FROM evaluation_question", "r")
def union_questions(s: SparkSession, d: str) -> DataFrame:
    a = k.responses(s, d).select(F.col("question_batch_id").alias("batch_id"), "question_id")
    return a.union(load(s, d, "evaluation_question").select("batch_id", "id")).distinct()


@query("SELECT doc_id FROM submission_sample EXCEPT SELECT doc_id FROM evaluation_mention_response")
def except_docs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "submission_sample").select("doc_id").subtract(load(s, d, "evaluation_mention_response").select("doc_id"))


@query("SELECT doc_id FROM submission_sample INTERSECT SELECT id FROM document")
def intersect_docs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "submission_sample").select("doc_id").intersect(load(s, d, "document").select("id"))


@query("SELECT u.id, EXISTS (SELECT 1 FROM submission_sample p WHERE p.submission_id = u.id) AS sampled FROM submission u")
def exists_sample(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "submission_sample").select(F.col("submission_id").alias("id")).distinct().withColumn("x", F.lit(True))
    return load(s, d, "submission").select("id").join(p, "id", "left").select("id", F.col("x").isNotNull().alias("sampled"))


# scalar functions over whole columns


@query(r"""SELECT DISTINCT link_name, translate(link_name, ' []''"%+?=<>|/()', '________________') AS wikified, translate(lower(link_name), ' []''"%+?=<>|/()\', '_________________') AS normalised,
 regexp_replace(link_name, '[^a-zA-Z0-9. ]', '%', 'g') AS pattern, ':' || regexp_replace(link_name, '[^A-Za-z0-9_]', '', 'g') || '_' || substr(md5(link_name), 1, 10) AS entity, starts_with(link_name, 'wiki:') AS is_wiki FROM submission_link WHERE link_name IS NOT NULL""")
def link_names(s: SparkSession, d: str) -> DataFrame:
    n = F.col("link_name")
    return load(s, d, "submission_link").select("link_name").dropna().distinct().select("link_name", sc.wikify(n).alias("wikified"), sc.normalise_entity(n).alias("normalised"), sc.sanitise_word(n).alias("pattern"), sc.entity_key(n).alias("entity"), F.startswith(n, F.lit("wiki:")).alias("is_wiki"))


@query("SELECT submission_id, doc_id, lo, hi, doc_id || ':' || lo || '-' || hi AS prov, doc_id AS p_doc, lo AS p_lo, hi AS p_hi, lo AS span_lo FROM m", "m")
def provenances(s: SparkSession, d: str) -> DataFrame:
    m = k.latest_mentions(s, d).select("submission_id", "doc_id", "lo", "hi").withColumn("prov", sc.show_provenance(F.col("doc_id"), F.col("lo"), F.col("hi")))
    p, q = sc.provenance(F.col("prov")), sc.parse_span(F.split_part("prov", F.lit(":"), F.lit(2)))
    return m.withColumns({"p": p, "q": q}).select("submission_id", "doc_id", "lo", "hi", "prov", F.col("p.doc_id").alias("p_doc"), F.col("p.lo").alias("p_lo"), F.col("p.hi").alias("p_hi"), F.col("q.lo").alias("span_lo"))


@query("SELECT m.submission_id, m.doc_id, m.lo, m.hi, substring(d.gloss, m.lo + 1, m.hi - m.lo) AS under, m.gloss = substring(d.gloss, m.lo + 1, m.hi - m.lo) AS same FROM m JOIN (SELECT DISTINCT id, gloss FROM document WHERE gloss IS NOT NULL) d ON m.doc_id = d.id", "m")
def text_under_span(s: SparkSession, d: str) -> DataFrame:
    t = load(s, d, "document").select(F.col("id").alias("doc_id"), F.col("gloss").alias("text")).filter(F.col("text").isNotNull()).distinct()
    u = sc.under_span(F.col("text"), F.lit(0), F.col("lo"), F.col("hi"))
    return k.latest_mentions(s, d).join(t, "doc_id").select("submission_id", "doc_id", "lo", "hi", u.alias("under"), (F.col("gloss") == u).alias("same"))


@query("""SELECT DISTINCT batch_id, id, json_extract_string(params, '$.batch_type') AS batch_type, json_extract_string(params, '$.doc_id') AS doc_id,
 TRY_CAST(json_extract_string(params, '$.subject.span[0]') AS INT) AS subject_lo, json_extract_string(params, '$.mention_1[1]') AS legacy FROM oq""", more=OPENED)
def json_question(s: SparkSession, d: str) -> DataFrame:
    at = lambda p: F.get_json_object("params", p)
    q = nested.with_object(load(s, d, "evaluation_question"), "params")
    return q.select("batch_id", "id", at("$.batch_type").alias("batch_type"), at("$.doc_id").alias("doc_id"), at("$.subject.span[0]").try_cast("int").alias("subject_lo"), at("$.mention_1[1]").alias("legacy")).distinct()


@query("""SELECT doc_id, sentence_index, lo, len(words) AS n, array_to_string(list_transform(words, lambda w: CASE w WHEN '-LRB-' THEN '(' WHEN '-RRB-' THEN ')' WHEN '``' THEN '"' ELSE w END), ' ') AS shown, list_max(list_transform(token_spans, lambda t: t.hi - t.lo)) AS longest
 FROM (SELECT DISTINCT doc_id, sentence_index, span.lo AS lo, words, token_spans FROM sentence)""")
def tokens(s: SparkSession, d: str) -> DataFrame:
    t = load(s, d, "sentence").selectExpr("doc_id", "sentence_index", "span.lo AS lo", "words", "token_spans").distinct()
    zipped = t.withColumn("z", F.arrays_zip(sc.words_unescaped(F.col("words")).alias("w"), F.col("token_spans").alias("t")))
    return zipped.select("doc_id", "sentence_index", "lo", F.size("words").cast("long").alias("n"), F.array_join(sc.words_unescaped(F.col("words")), " ").alias("shown"), F.array_max(F.transform("z", lambda z: z.t.hi - z.t.lo)).alias("longest"))


@query("SELECT kb_entity, count(*) AS n, CASE WHEN count(*) <= 3 THEN 'low' WHEN count(*) <= 100 THEN 'med' ELSE 'high' END AS bin FROM documents WHERE kb_entity IS NOT NULL GROUP BY kb_entity")
def freq_bins(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").filter(F.col("kb_entity").isNotNull()).groupBy("kb_entity").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", sc.frequency_bin(F.col("n")))


@query("""SELECT CASE WHEN n <= q[1] THEN 0 WHEN n <= q[2] THEN 1 ELSE 2 END AS bin, count(*) AS n_entities FROM n, (SELECT [quantile_cont(n, 0.5), quantile_cont(n, 0.9)] AS q FROM n) GROUP BY ALL""", more="n AS (SELECT kb_entity, count(*) AS n FROM documents WHERE kb_entity IS NOT NULL GROUP BY kb_entity)")
def percentile_bins(s: SparkSession, d: str) -> DataFrame:
    n = load(s, d, "documents").filter(F.col("kb_entity").isNotNull()).groupBy("kb_entity").agg(F.count(F.lit(1)).alias("n"))
    q = n.agg(F.percentile("n", F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
    return n.crossJoin(F.broadcast(q)).groupBy(F.when(F.col("n") <= F.col("q")[0], 0).when(F.col("n") <= F.col("q")[1], 1).otherwise(2).alias("bin")).agg(F.count(F.lit(1)).alias("n_entities"))


@query("SELECT CASE WHEN n_chars < 100 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 10000 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 1000000 GROUP BY ALL")
def histogram(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select(sc.histogram_bin(F.col("n_chars"), [0, 100, 1000, 10000, 1000000]).alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(floor(log10(n_chars)) AS BIGINT) AS magnitude, lang, count(*) AS n FROM documents WHERE n_chars > 0 GROUP BY ALL")
def log_histogram(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").filter("n_chars > 0").groupBy(F.floor(F.log10("n_chars")).alias("magnitude"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT least(n, 5) AS size, count(*) AS n_groups FROM (SELECT submission_id, doc_id, c_lo, c_hi, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL", "m")
def capped_sizes(s: SparkSession, d: str) -> DataFrame:
    n = k.latest_mentions(s, d).groupBy("submission_id", "doc_id", "c_lo", "c_hi").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.least("n", F.lit(5).cast("long")).alias("size")).agg(F.count(F.lit(1)).alias("n_groups"))


@query("""SELECT doc_id, sentence_lo, s_lo, s_hi, b_lo, b_hi, CASE WHEN s_lo <= b_lo THEN
 substring(g, 1, s_lo - sentence_lo) || '*' || substring(g, s_lo - sentence_lo + 1, s_hi - s_lo) || '*' || CASE WHEN b_lo > s_hi THEN substring(g, s_hi - sentence_lo + 1, b_lo - s_hi) ELSE '' END || '^' || substring(g, b_lo - sentence_lo + 1, b_hi - b_lo) || '^' || substring(g, b_hi - sentence_lo + 1)
 ELSE substring(g, 1, b_lo - sentence_lo) || '^' || substring(g, b_lo - sentence_lo + 1, b_hi - b_lo) || '^' || CASE WHEN s_lo > b_hi THEN substring(g, b_hi - sentence_lo + 1, s_lo - b_hi) ELSE '' END || '*' || substring(g, s_lo - sentence_lo + 1, s_hi - s_lo) || '*' || substring(g, s_hi - sentence_lo + 1) END AS example
 FROM (SELECT DISTINCT p.doc_id, s_lo, s_hi, b_lo, b_hi, t.span.lo AS sentence_lo, t.gloss AS g FROM p JOIN sentence t ON p.doc_id = t.doc_id AND t.span.lo <= least(s_lo, b_lo) AND greatest(s_hi, b_hi) <= t.span.hi WHERE t.gloss IS NOT NULL)""", more=_SAMPLE)
def rendered_examples(s: SparkSession, d: str) -> DataFrame:
    p = _samples(s, d).select("doc_id", "s_lo", "s_hi", "b_lo", "b_hi").distinct().withColumns({"lo": F.least("s_lo", "b_lo"), "hi": F.greatest("s_hi", "b_hi")})
    t = load(s, d, "sentence").selectExpr("doc_id", "span.lo AS o_lo", "span.hi AS o_hi", "gloss").distinct()
    j = ranges.contained_in(p, t, ["doc_id"]).filter("gloss IS NOT NULL").select("doc_id", "o_lo", "s_lo", "s_hi", "b_lo", "b_hi", "gloss").distinct()
    return j.select("doc_id", F.col("o_lo").alias("sentence_lo"), "s_lo", "s_hi", "b_lo", "b_hi", sc.marked(F.col("gloss"), *map(F.col, ("o_lo", "s_lo", "s_hi", "b_lo", "b_hi"))).alias("example"))


@query()
def token_levenshtein(s: SparkSession, d: str) -> DataFrame:
    """The least distance in code points between a word of a mention's gloss and a word of its link's name, in any script."""
    key = ["submission_id", "doc_id", "lo", "hi"]
    a = k.latest_mentions(s, d).filter("gloss <> ''").select(*key, F.explode(F.split(F.lower("gloss"), r"[\s\p{Z}]")).alias("a"))
    b = k.latest_links(s, d).filter("link_name <> ''").select(*key, F.explode(F.split(F.lower(F.replace("link_name", F.lit("wiki:"), F.lit(""))), "_")).alias("b"))
    return a.join(b, key).groupBy(*key).agg(F.min(F.levenshtein("a", "b")).alias("distance"))


@query("SELECT DISTINCT doc_id, coalesce(lpad(CAST(year(doc_date) AS VARCHAR), 4, '0'), 'XXXX') || '-' || coalesce(lpad(CAST(month(doc_date) AS VARCHAR), 2, '0'), 'XX') || '-' || coalesce(lpad(CAST(day(doc_date) AS VARCHAR), 2, '0'), 'XX') AS shown, CAST(updated + INTERVAL 1 DAY AS TIMESTAMP) AS next_day FROM documents")
def partial_dates(s: SparkSession, d: str) -> DataFrame:
    c = F.col("doc_date")
    return load(s, d, "documents").select("doc_id", sc.partial_date(F.year(c), F.month(c), F.dayofmonth(c)).alias("shown"), (F.col("updated") + F.expr("INTERVAL 1 DAY")).alias("next_day")).distinct()


# dictionaries

_RAW = """raw AS (SELECT submission_id, doc_id, subject_lo, object_lo, subject_type, object_type, CASE relation WHEN 'per:place_of_residence' THEN 'per:cities_of_residence' WHEN 'org:place_of_headquarters' THEN 'gpe:headquarters_in_city' ELSE relation END AS stated FROM k_relation)"""


@query("""SELECT submission_id, doc_id, subject_lo, object_lo, stated, CASE stated WHEN 'per:cities_of_residence' THEN 'per:place_of_residence' WHEN 'gpe:headquarters_in_city' THEN 'gpe:headquarters_in_place' ELSE stated END AS relation,
 CASE stated WHEN 'per:spouse' THEN 'per:spouse' WHEN 'per:cities_of_residence' THEN 'gpe:residents_in_place' WHEN 'per:employee_or_member_of' THEN 'org:employees_or_members' WHEN 'org:founded_by' THEN 'per:organizations_founded' END AS inverse,
 CASE stated WHEN 'gpe:headquarters_in_city' THEN false WHEN 'org:founded_by' THEN false ELSE true END AS canonical FROM raw""", "k_relation", more=_RAW)
def standardised_relations(s: SparkSession, d: str) -> DataFrame:
    stated = F.when(F.col("relation") == "per:place_of_residence", "per:cities_of_residence").when(F.col("relation") == "org:place_of_headquarters", "gpe:headquarters_in_city").otherwise(F.col("relation"))
    r = k.relations(s, d).withColumn("stated", stated).withColumn("relation", dic.lookup(dic.ALIASES, F.col("stated")))
    return r.select("submission_id", "doc_id", "subject_lo", "object_lo", "stated", "relation", dic.inverse(F.col("relation"), F.col("object_type")).alias("inverse"), dic.is_canonical(F.col("relation"), F.col("subject_type"), F.col("object_type")).alias("canonical"))


@query("SELECT relation, subject_type, object_type, count(*) AS n FROM k_relation WHERE (relation, subject_type, object_type) IN (" + ", ".join(f"('{r}', '{x}', '{o}')" for r, (x, os) in (dic.CANONICAL | dic.ONLY_INVERSE).items() for o in os) + ") GROUP BY ALL", "k_relation")
def admitted_types(s: SparkSession, d: str) -> DataFrame:
    return k.relations(s, d).join(F.broadcast(dic.argument_types(s)), ["relation", "subject_type", "object_type"], "left_semi").groupBy("relation", "subject_type", "object_type").agg(F.count(F.lit(1)).alias("n"))


# audits


@query("SELECT assignment_id, doc_id, lo, hi, count(*) AS n FROM (SELECT assignment_id, doc_id, span.lo AS lo, span.hi AS hi FROM evaluation_mention_response) GROUP BY ALL HAVING count(*) > 1")
def audit_pk(s: SparkSession, d: str) -> DataFrame:
    return audits.duplicate_keys(load(s, d, "evaluation_mention_response").selectExpr("assignment_id", "doc_id", "span.lo AS lo", "span.hi AS hi"), ["assignment_id", "doc_id", "lo", "hi"])


@query("SELECT l.submission_id, l.doc_id, l.lo, l.hi, l.link_name FROM l ANTI JOIN m USING (submission_id, doc_id, lo, hi)", "l", "m")
def audit_fk(s: SparkSession, d: str) -> DataFrame:
    return audits.missing_parents(k.latest_links(s, d), k.latest_mentions(s, d), ["submission_id", "doc_id", "lo", "hi"]).select("submission_id", "doc_id", "lo", "hi", "link_name")


@query("SELECT id, 'tokens' AS what FROM sentence WHERE len(words) <> len(token_spans) UNION ALL SELECT id, 'lemmas' FROM sentence WHERE len(words) <> len(lemmas) UNION ALL SELECT id, 'span' FROM sentence WHERE span.hi - span.lo <> length(gloss)")
def audit_check(s: SparkSession, d: str) -> DataFrame:
    t = load(s, d, "sentence")
    bad = lambda what, check: audits.violations(t, check).select("id", F.lit(what).alias("what"))
    return bad("tokens", F.size("words") == F.size("token_spans")).union(bad("lemmas", F.size("words") == F.size("lemmas"))).union(bad("span", F.col("span.hi") - F.col("span.lo") == F.char_length("gloss")))


@query("SELECT batch_type, count(*) AS n FROM evaluation_batch WHERE batch_type NOT IN ('selective_relations', 'exhaustive_relations', 'exhaustive_entities') GROUP BY ALL")
def audit_state(s: SparkSession, d: str) -> DataFrame:
    b = load(s, d, "evaluation_batch")
    return audits.violations(b, F.col("batch_type").isin("selective_relations", "exhaustive_relations", "exhaustive_entities")).groupBy("batch_type").agg(F.count(F.lit(1)).alias("n"))
