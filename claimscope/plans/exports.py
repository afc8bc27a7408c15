"""Queries of stratified samples, exports, read models and what else the stored tables are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions import dictionaries as dic
from claimscope.functions import scalars as sc
from claimscope.operators import distributions as dist
from claimscope.operators import nested, ranges, schemes
from claimscope.operators.ordering import distinct_on, latest, mode_with_nulls, top
from claimscope.operators.questions import relation_questions
from claimscope.plans.sampling import _DER, _U, entity_relation_distribution
from claimscope.session import written
from claimscope.sources import derived as k
from claimscope.sources.derived import sql
from claimscope.sources.kbfiles import _TYPES
from claimscope.tables import load

QUERIES, SQL = {}, {}


def query(body: str | None = None, *with_views: str, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = sql(body, *with_views, more=more) if with_views or more else body
        return f

    return add


def _rounded(df: DataFrame, n: int = 8) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# stratified samples

_IX = """ix AS (SELECT DISTINCT submission_id AS kb, subject_entity AS entity, relation, object_entity AS object, doc_id || ':' || subject_lo || ':' || subject_hi || ':' || object_lo || ':' || object_hi AS x FROM k_relation),
fi AS (SELECT kb, entity, relation, object, count(*) AS n_fill FROM ix GROUP BY ALL), en AS (SELECT kb, entity, count(*) AS n_fills FROM fi GROUP BY ALL), re AS (SELECT kb, relation, sum(n_fill)::BIGINT AS n_relation FROM fi GROUP BY ALL),
sz AS (SELECT ix.*, n_fill, n_fills, n_relation, (SELECT count(*) FROM en WHERE en.kb = ix.kb) AS n_entities, (SELECT count(*) FROM ix b WHERE b.kb = ix.kb) AS n_all, (SELECT count(*) FROM re b WHERE b.kb = ix.kb) AS n_relations
 FROM ix JOIN fi USING (kb, entity, relation, object) JOIN en USING (kb, entity) JOIN re USING (kb, relation)),
bo AS (SELECT *, row_number() OVER (PARTITION BY kb ORDER BY n_relation, relation) AS rn, count(*) OVER (PARTITION BY kb) AS m FROM re),
bu(kb, rn, relation, per, taken, rest) AS (SELECT kb, rn, relation, 200 // m, least(200 // m, n_relation), 200 - least(200 // m, n_relation) FROM bo WHERE rn = 1
 UNION ALL SELECT bo.kb, bo.rn, bo.relation, rest // (m - bu.rn), least(rest // (m - bu.rn), n_relation), rest - least(rest // (m - bu.rn), n_relation) FROM bu JOIN bo ON bo.kb = bu.kb AND bo.rn = bu.rn + 1),
br AS (SELECT sz.*, per FROM sz JOIN bu USING (kb, relation) QUALIFY row_number() OVER (PARTITION BY kb, relation ORDER BY {u}, entity, object, x) <= max(taken) OVER (PARTITION BY kb, relation))""".replace("{u}", _U.format(key="'br|' || kb || '|' || entity || '|' || relation || '|' || object || '|' || x"))
_MER = "round({p} / n_all::DOUBLE, 8) AS mw, {e} AS ew, round({p} / (n_relation * n_relations)::DOUBLE, 8) AS rw"
_PE = "(n_entities * n_fills * n_fill)::DOUBLE"


def _indexed(s: SparkSession, d: str) -> DataFrame:
    x = F.concat_ws(":", "doc_id", "subject_lo", "subject_hi", "object_lo", "object_hi")
    return k.relations(s, d).select(F.col("submission_id").alias("kb"), F.col("subject_entity").alias("entity"), "relation", F.col("object_entity").alias("object"), x.alias("x")).distinct()


@query("SELECT kb, entity, relation, object, x, " + _MER.format(p="(n_relation * 200.0::DOUBLE / least(n_relation, per))", e=f"round((n_relation * 200.0::DOUBLE / least(n_relation, per)) / {_PE}, 8)") + " FROM br", "k_relation", more=_IX)
def sample_by_relation(s: SparkSession, d: str) -> DataFrame:
    """200 instances of each submission, relations as even as their counts allow, with importance weights."""
    return _rounded(schemes.by_relation(_indexed(s, d), 200, "br"))


@query("SELECT DISTINCT sz.kb, sz.entity, sz.relation, sz.object, sz.x, " + _MER.format(p=_PE, e="1.0::DOUBLE") + f""" FROM (SELECT kb, entity, draw, least(floor({_U.format(key="'bef|' || kb || '|' || entity || '|' || draw")} * n_fills), n_fills - 1) AS f FROM
 (SELECT kb, entity, n_fills, row_number() OVER (PARTITION BY kb ORDER BY {_U.format(key="'be|' || kb || '|' || entity")}, entity) AS e FROM en), range(1, 4) t(draw) WHERE (e - 1) * 3 + draw <= 200) dr
 JOIN (SELECT kb, entity, relation, object, row_number() OVER (PARTITION BY kb, entity ORDER BY relation, object) - 1 AS f FROM fi) ff ON ff.kb = dr.kb AND ff.entity = dr.entity AND ff.f = dr.f
 JOIN (SELECT *, row_number() OVER (PARTITION BY kb, entity, relation, object ORDER BY x) - 1 AS i FROM sz) sz ON sz.kb = ff.kb AND sz.entity = ff.entity AND sz.relation = ff.relation AND sz.object = ff.object
 AND sz.i = least(floor({_U.format(key="'bei|' || dr.kb || '|' || dr.entity || '|' || dr.draw")} * n_fill), n_fill - 1)""", "k_relation", more=_IX)
def sample_by_entity(s: SparkSession, d: str) -> DataFrame:
    """Three draws of a fill and an instance of each entity, up to 200 draws of a submission."""
    return _rounded(schemes.by_entity(_indexed(s, d), 200, 3, "be"))


@query("SELECT kb, entity, relation, object, x, " + _MER.format(p="(n_relation * nn / seen::DOUBLE)", e=f"round((n_relation * nn / seen::DOUBLE) / {_PE}, 8)") + " FROM (SELECT *, count(*) OVER (PARTITION BY kb, relation) AS seen, count(*) OVER (PARTITION BY kb) AS nn FROM br)", "k_relation", more=_IX)
def reweighted_sample(s: SparkSession, d: str) -> DataFrame:
    """That sample weighted by the relations it holds."""
    i = _indexed(s, d)
    return _rounded(schemes.reweighted(schemes.by_relation(i, 200, "br"), i, "relation"))


@query(f"""SELECT kb, entity, relation, object, x, correct, round(2 * CASE WHEN correct THEN t ELSE r - t END / r::DOUBLE, 8) AS mw FROM (SELECT *, row_number() OVER (PARTITION BY kb, correct ORDER BY {_U.format(key="'bl|' || kb || '|' || entity || '|' || relation || '|' || object || '|' || x")}, entity, relation, object, x) AS rn,
 count(*) OVER (PARTITION BY kb) AS r, count(*) FILTER (WHERE correct) OVER (PARTITION BY kb) AS t FROM lx) WHERE rn <= 50""", "k_relation", "k_gold", more="""lx AS (SELECT DISTINCT submission_id AS kb, subject_entity AS entity, k.relation, object_entity AS object, k.doc_id || ':' || k.subject_lo || ':' || subject_hi || ':' || k.object_lo || ':' || object_hi AS x, correct
 FROM k_relation k JOIN k_gold g ON k.doc_id = g.doc_id AND k.subject_lo = g.subject_lo AND k.object_lo = g.object_lo WHERE correct IS NOT NULL)""")
def sample_by_label(s: SparkSession, d: str) -> DataFrame:
    """Fifty right and fifty wrong instances of each submission."""
    x = F.concat_ws(":", "doc_id", "subject_lo", "subject_hi", "object_lo", "object_hi")
    labelled = k.relations(s, d).join(k.gold(s, d).select("doc_id", "subject_lo", "object_lo", "correct"), ["doc_id", "subject_lo", "object_lo"]).select(F.col("submission_id").alias("kb"), F.col("subject_entity").alias("entity"), "relation", F.col("object_entity").alias("object"), x.alias("x"), "correct").distinct()
    return _rounded(schemes.by_label(labelled, 100, "bl"))


@query("""SELECT kb, 'instance' AS kind, bin AS value, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT kb, 'relation', relation, count(*) FROM b GROUP BY ALL UNION ALL SELECT kb, 'cluster ' || bin, CAST(c AS VARCHAR), count(*) FROM (SELECT kb, entity, bin, count(*) AS c FROM b GROUP BY ALL) GROUP BY ALL""", "k_relation",
       more=_IX + ",\ncn AS (SELECT kb, entity, sum(n_fill) AS n FROM fi GROUP BY ALL), b AS (SELECT br.*, CASE WHEN n <= 3 THEN 'low' WHEN n <= 100 THEN 'med' ELSE 'high' END AS bin FROM br JOIN cn USING (kb, entity))")
def scheme_statistics(s: SparkSession, d: str) -> DataFrame:
    """How a sample falls on frequency bins of entities, on relations, and on sizes of entities' clusters."""
    i = _indexed(s, d)
    n = i.groupBy("kb", "entity").agg(F.count(F.lit(1)).alias("n"))
    b = written(schemes.by_relation(i, 200, "br").join(n, ["kb", "entity"]).withColumn("bin", sc.frequency_bin(F.col("n"))), "binned")
    part = lambda df, kind, value: df.groupBy("kb", kind.alias("kind"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    clusters = b.groupBy("kb", "entity", "bin").agg(F.count(F.lit(1)).alias("c"))
    return part(b, F.lit("instance"), F.col("bin")).unionByName(part(b, F.lit("relation"), F.col("relation"))).unionByName(part(clusters, F.concat(F.lit("cluster "), "bin"), F.col("c").cast("string")))


@query(f"""SELECT submission_id, 'entity_relation' AS distribution_type, '{{"type": "entity_relation", "with_replacement": false}}' AS params, doc_id, subject_lo, object_lo FROM
 (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY -ln({_U.format(key="'sb|' || submission_id || '|' || doc_id || '|' || subject_lo || '|' || object_lo")}) / p, doc_id, subject_lo, object_lo) AS rn FROM (SELECT submission_id, doc_id, subject_lo, object_lo, sum(p) AS p FROM pd GROUP BY ALL)) WHERE rn <= 50""", "k_relation", more=_DER)
def submission_batches(s: SparkSession, d: str) -> DataFrame:
    """A new sample batch of 50 instances of each submission by the distribution systems are sampled by."""
    ids = ["submission_id", "doc_id", "subject_lo", "object_lo"]
    p = entity_relation_distribution(s, d).groupBy(*ids).agg(F.sum("p").alias("p"))
    drawn = dist.draw_without_replacement(p, ["submission_id"], ids, "p", 50, "sb")
    return drawn.select("submission_id", F.lit("entity_relation").alias("distribution_type"), F.lit('{"type": "entity_relation", "with_replacement": false}').alias("params"), "doc_id", "subject_lo", "object_lo")


# exports

_CASE = "CASE mention_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items()) + " END"


@query(f"SELECT mention_type, {_CASE} AS name, count(*) AS n FROM m GROUP BY mention_type", "m")
def ner_types(s: SparkSession, d: str) -> DataFrame:
    """The type each stated type stands for, null for others."""
    n = k.latest_mentions(s, d).groupBy("mention_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("mention_type", dic.lookup(_TYPES, F.col("mention_type")).alias("name"), "n")


@query(f"""SELECT submission_id, part, line FROM (SELECT submission_id, 0 AS part, p || chr(9) || t || chr(9) || coalesce(gloss, '') AS line FROM vm UNION ALL
 SELECT vm.submission_id, 1, vm.p || chr(9) || 'canonical_mention' || chr(9) || c.p FROM vm JOIN vm c ON c.submission_id = vm.submission_id AND c.doc_id = vm.doc_id AND c.lo = vm.c_lo AND c.hi = vm.c_hi UNION ALL
 SELECT submission_id, 2, p || chr(9) || 'link' || chr(9) || link_name FROM vm JOIN l USING (submission_id, doc_id, lo, hi) WHERE link_name IS NOT NULL)""", "m", "l", more=f"vm AS (SELECT *, doc_id || ':' || lo || '-' || hi AS p, {_CASE} AS t FROM m WHERE {_CASE} IS NOT NULL)")
def statement_export(s: SparkSession, d: str) -> DataFrame:
    """Submissions as statement lines; mentions of no known type go, and whatever refers to them."""
    m = k.latest_mentions(s, d).withColumn("t", dic.lookup(_TYPES, F.col("mention_type"))).filter("t IS NOT NULL").withColumn("p", sc.show_provenance(F.col("doc_id"), F.col("lo"), F.col("hi")))
    key = ["submission_id", "doc_id"]
    line = lambda df, part, *cells: df.select("submission_id", F.lit(part).alias("part"), F.concat_ws("\t", *cells).alias("line"))
    c = m.select(*key, F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), F.col("p").alias("cp"))
    links = m.join(k.latest_links(s, d).filter("link_name IS NOT NULL").select(*key, "lo", "hi", "link_name"), [*key, "lo", "hi"])
    return line(m, 0, "p", "t", F.coalesce("gloss", F.lit(""))).unionByName(line(m.join(c, [*key, "c_lo", "c_hi"]), 1, "p", F.lit("canonical_mention"), "cp")).unionByName(line(links, 2, "p", F.lit("link"), "link_name"))


@query("""SELECT submission_id, subject_entity, relation, object_entity, doc_id, subject_lo, object_lo, round(confidence, 6) AS confidence FROM k_relation QUALIFY row_number() OVER (PARTITION BY submission_id, subject_entity, relation, object_entity
 ORDER BY least(abs(2 - abs(object_lo - subject_hi)), abs(2 - abs(subject_lo - object_hi))), confidence, doc_id, subject_lo, subject_hi, object_lo, object_hi) = 1""", "k_relation")
def kb_export_relations(s: SparkSession, d: str) -> DataFrame:
    """One instance for each statement about two entities: that whose arguments are nearest, then the least sure."""
    near = F.least(F.abs(2 - F.abs(F.col("object_lo") - F.col("subject_hi"))), F.abs(2 - F.abs(F.col("subject_lo") - F.col("object_hi"))))
    order = [F.col(c) for c in ("near", "confidence", "doc_id", "subject_lo", "subject_hi", "object_lo", "object_hi")]
    one = distinct_on(k.relations(s, d).withColumn("near", near), ["submission_id", "subject_entity", "relation", "object_entity"], order)
    return one.select("submission_id", "subject_entity", "relation", "object_entity", "doc_id", "subject_lo", "object_lo", F.round("confidence", 6).alias("confidence"))


@query("""SELECT a.doc_id, a.lo, a.hi, a.mention_type, a.gloss, b.lo AS canonical_lo, b.hi AS canonical_hi, b.gloss AS canonical_gloss FROM m a JOIN m b ON a.submission_id = b.submission_id AND a.doc_id = b.doc_id AND a.c_lo = b.lo AND a.c_hi = b.hi AND a.mention_type = b.mention_type
 WHERE a.doc_id LIKE '%ENG\\_%' ESCAPE '\\' AND a.doc_id NOT LIKE '%\\_DF\\_%' ESCAPE '\\' AND a.mention_type IN ('PER', 'ORG', 'GPE', 'DATE', 'TITLE') QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.lo, a.hi ORDER BY a.submission_id) = 1""", "m")
def extractor_export(s: SparkSession, d: str) -> DataFrame:
    """Mentions of English documents that aren't threads, with a canonical mention of their type, one per span."""
    m = k.latest_mentions(s, d).filter(F.col("doc_id").rlike("ENG_") & ~F.col("doc_id").rlike("_DF_") & F.col("mention_type").isin(*dic.ENTITY_TYPES, *dic.STRING_TYPES))
    key = ["submission_id", "doc_id", "mention_type"]
    c = m.select(*key, F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), F.col("gloss").alias("canonical_gloss"))
    one = distinct_on(m.join(c, [*key, "c_lo", "c_hi"]), ["doc_id", "lo", "hi"], [F.col("submission_id")])
    return one.select("doc_id", "lo", "hi", "mention_type", "gloss", F.col("c_lo").alias("canonical_lo"), F.col("c_hi").alias("canonical_hi"), "canonical_gloss")


_P = "p AS (SELECT DISTINCT submission_id, doc_id, subject.lo AS s_lo, subject.hi AS s_hi, \"object\".lo AS b_lo, \"object\".hi AS b_hi FROM submission_sample)"


def _samples(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "submission_sample").selectExpr("submission_id", "doc_id", "subject.lo AS s_lo", "subject.hi AS s_hi", "object.lo AS b_lo", "object.hi AS b_hi").distinct()


@query("""SELECT DISTINCT doc_id || '-' || s_lo || '-' || s_hi || '-' || b_lo || '-' || b_hi || '.json' AS name, '{"doc_id":"' || doc_id || '","subject":[' || s_lo || ',' || s_hi || '],"object":[' || b_lo || ',' || b_hi || ']}' AS content FROM p""", more=_P)
def flattened_samples(s: SparkSession, d: str) -> DataFrame:
    """One JSON text for each sampled pair, with the name of its file."""
    p = _samples(s, d).drop("submission_id").distinct()
    content = F.to_json(F.struct("doc_id", F.array("s_lo", "s_hi").alias("subject"), F.array("b_lo", "b_hi").alias("object")))
    return p.select(F.concat(F.concat_ws("-", "doc_id", "s_lo", "s_hi", "b_lo", "b_hi"), F.lit(".json")).alias("name"), content.alias("content"))


@query("""SELECT submission_id, doc_id, count(*) AS n, '[' || string_agg('[' || s_lo || ',' || s_hi || ',' || b_lo || ',' || b_hi || ']', ',' ORDER BY s_lo, s_hi, b_lo, b_hi) || ']' AS pairs FROM p GROUP BY ALL""", more=_P)
def task_texts(s: SparkSession, d: str) -> DataFrame:
    """One task for each sampled document of a submission: its pairs as JSON."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("s_lo", "s_hi", "b_lo", "b_hi"))), lambda x: F.array(x.s_lo, x.s_hi, x.b_lo, x.b_hi))
    return _samples(s, d).groupBy("submission_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.to_json(pairs).alias("pairs"))


@query("SELECT DISTINCT q.batch_id, q.id, q.state, b.batch_type FROM (SELECT DISTINCT question_batch_id, question_id FROM r) x JOIN evaluation_question q ON q.batch_id = x.question_batch_id AND q.id = x.question_id JOIN evaluation_batch b ON b.id = q.batch_id", "r")
def answered_questions(s: SparkSession, d: str) -> DataFrame:
    """The questions an export of answers needs, with their batches."""
    r = k.responses(s, d).select(F.col("question_batch_id").alias("batch_id"), F.col("question_id").alias("id"))
    q = load(s, d, "evaluation_question").select("batch_id", "id", "state").distinct().join(r, ["batch_id", "id"], "left_semi")
    return q.join(load(s, d, "evaluation_batch").select(F.col("id").alias("batch_id"), "batch_type").distinct(), "batch_id").select("batch_id", "id", "state", "batch_type").distinct()


@query("""SELECT corpus_tag, 'documents' AS table_name, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT corpus_tag, 'submission', count(*) FROM submission GROUP BY ALL UNION ALL SELECT corpus_tag, 'mention', count(*) FROM m JOIN submission u ON u.id = m.submission_id GROUP BY ALL
 UNION ALL SELECT corpus_tag, 'link', count(*) FROM l JOIN submission u ON u.id = l.submission_id GROUP BY ALL UNION ALL SELECT corpus_tag, 'sample_batch', count(DISTINCT id) FROM sample_batch GROUP BY ALL""", "m", "l")
def corpus_export(s: SparkSession, d: str) -> DataFrame:
    """What an export of each corpus holds: rows of its five tables."""
    u = load(s, d, "submission")
    of = lambda df: df.join(u.select(F.col("id").alias("submission_id"), "corpus_tag"), "submission_id")
    tables = {"documents": load(s, d, "documents"), "submission": u, "mention": of(k.latest_mentions(s, d)), "link": of(k.latest_links(s, d)), "sample_batch": load(s, d, "sample_batch").select("id", "corpus_tag").distinct()}
    parts = [t.groupBy("corpus_tag").agg(F.count(F.lit(1)).alias("n")).select("corpus_tag", F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT DISTINCT doc_id, sentence_index, lo, hi, to_json(list_transform(token_spans, lambda t: [t.lo, t.hi])) AS spans FROM (SELECT doc_id, sentence_index, span.lo AS lo, span.hi AS hi, token_spans FROM sentence)")
def rebuilt_spans(s: SparkSession, d: str) -> DataFrame:
    """Begins and ends of tokens, kept apart in an older layout, zipped into spans again."""
    t = load(s, d, "sentence").selectExpr("doc_id", "sentence_index", "span.lo AS lo", "span.hi AS hi", "token_spans.lo AS begins", "token_spans.hi AS ends")
    zipped = F.transform(F.arrays_zip("begins", "ends"), lambda z: F.array(z.begins, z.ends))
    return t.select("doc_id", "sentence_index", "lo", "hi", F.to_json(zipped).alias("spans")).distinct()


# small reads


@query("SELECT id, title, doc_length FROM (SELECT DISTINCT id, title, doc_length FROM document) WHERE id = (SELECT min(id) FROM document)")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    """One document by its id (the least one there is)."""
    t = load(s, d, "document")
    first = t.agg(F.min("id").alias("id")).first()["id"]
    return t.filter(F.col("id") == first).select("id", "title", "doc_length").distinct()


@query("SELECT corpus_tag, count(DISTINCT doc_id) AS n FROM documents WHERE source IN (SELECT source FROM mix_target WHERE target_share > 0) GROUP BY ALL")
def seeded_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents of a list that the driver holds (sources with a share)."""
    names = [(r["source"],) for r in load(s, d, "mix_target").filter("target_share > 0").select("source").distinct().limit(1000).collect()]
    return load(s, d, "documents").join(s.createDataFrame(names, "source string"), "source", "left_semi").groupBy("corpus_tag").agg(F.countDistinct("doc_id").alias("n"))


@query("SELECT submission_id, relation, count(*) AS n FROM k_relation GROUP BY ALL", "k_relation")
def snapshot_counts(s: SparkSession, d: str) -> DataFrame:
    """A view as a stored snapshot, read back."""
    return written(k.relations(s, d).groupBy("submission_id", "relation").agg(F.count(F.lit(1)).alias("n")), "snapshot")


@query("SELECT DISTINCT l_discount AS p, l_tax AS r, '(' || l_discount || ',' || l_tax || ',0.5)' AS score FROM lineitem")
def score_texts(s: SparkSession, d: str) -> DataFrame:
    """Scores written as text and read again."""
    text = F.concat(F.lit("("), F.col("l_discount").cast("string"), F.lit(","), F.col("l_tax").cast("string"), F.lit(",0.5)"))
    t = load(s, d, "lineitem").select(text.alias("score")).distinct().withColumn("x", sc.parse_score(F.col("score")))
    return t.select(F.col("x.precision").alias("p"), F.col("x.recall").alias("r"), sc.show_score(F.col("x.precision"), F.col("x.recall"), F.col("x.f1")).alias("score"))


@query("SELECT DISTINCT link_name, link_name AS again, replace(link_name, ' ', '') AS no_spaces FROM submission_link WHERE link_name IS NOT NULL AND link_name NOT LIKE '%' || chr(160) || '%' AND link_name NOT LIKE '%Â%'")
def unquoted_links(s: SparkSession, d: str) -> DataFrame:
    """Percent escapes undone, and no-break spaces repaired (names that hold one by themselves left out)."""
    n = F.col("link_name")
    t = load(s, d, "submission_link").select("link_name").dropna().distinct().filter(~n.contains(" ") & ~n.contains("Â"))
    quoted = F.replace(F.url_encode(n), F.lit("+"), F.lit("%20"))
    broken = F.replace(n, F.lit(" "), F.lit(" "))
    return t.select("link_name", sc.unquote(quoted).alias("again"), F.replace(sc.plain_spaces(broken), F.lit(" "), F.lit("")).alias("no_spaces"))


@query("SELECT DISTINCT 'SF_Team' || (run_id // 2) || (run_id % 2) AS run, 'Team' || (run_id // 2) AS team, CASE WHEN run_id = 0 THEN 0 ELSE CAST(floor(run_id / 10.0 * 40) AS BIGINT) END AS range_lo, 40 - run_id AS range_hi FROM k_run", "k_run")
def run_teams(s: SparkSession, d: str) -> DataFrame:
    """Teams by the names of their runs, and fractional ranges as positions; negative ends count from the back."""
    r = k.runs(s, d).select("run_id").distinct().withColumn("run", F.concat(F.lit("SF_Team"), F.expr("run_id div 2"), F.col("run_id") % 2))
    lo, _ = sc.whole_range(F.col("run_id") / 10, F.lit(1.0), F.lit(40))
    _, hi = sc.whole_range(F.lit(0.0), F.when(F.col("run_id") > 1, -F.col("run_id").cast("double")).otherwise(40.0 - F.col("run_id")), F.lit(40))
    return r.select("run", sc.team_of(F.col("run")).alias("team"), lo.alias("range_lo"), hi.alias("range_hi"))


# joins and aggregates


@query("""SELECT x.submission_id, x.doc_id, x.subject_lo, x.object_lo, bool_or(CASE WHEN g.relation = x.relation THEN g.correct END) AS label FROM (SELECT DISTINCT submission_id, doc_id, subject_lo, object_lo, relation FROM k_relation WHERE doc_id IN (SELECT doc_id FROM k_gold)) x
 JOIN k_gold g ON g.doc_id = x.doc_id AND g.subject_lo = x.subject_lo AND g.object_lo = x.object_lo GROUP BY ALL""", "k_relation", "k_gold")
def sampled_labels(s: SparkSession, d: str) -> DataFrame:
    """Instances with a gold entry at their arguments and their label, null where the relation differs or has none."""
    key = ["doc_id", "subject_lo", "object_lo"]
    x = k.relations(s, d).select("submission_id", *key, "relation").distinct()
    g = k.gold(s, d).select(*key, F.col("relation").alias("g"), "correct")
    return x.join(g, key).groupBy("submission_id", *key).agg(F.bool_or(F.when(F.col("g") == F.col("relation"), F.col("correct"))).alias("label"))


@query("SELECT submission_id, count(*) AS n FROM m WHERE doc_id NOT IN (SELECT doc_id FROM submission_sample WHERE doc_id IS NOT NULL) GROUP BY ALL", "m")
def without_sampled_documents(s: SparkSession, d: str) -> DataFrame:
    """What stays when the facts of a list of documents are deleted."""
    return k.latest_mentions(s, d).join(load(s, d, "submission_sample").select("doc_id").distinct(), "doc_id", "left_anti").groupBy("submission_id").agg(F.count(F.lit(1)).alias("n"))


_LEGACY = """fs AS (SELECT m.submission_id, m.doc_id, m.lo, m.hi, m.mention_type AS t, m.gloss, coalesce(l.link_name, '') AS link, min(row(s.lo, s.hi)) AS sent FROM m JOIN s ON s.doc_id = m.doc_id AND s.lo <= m.lo AND m.hi <= s.hi AND m.lo < m.hi LEFT JOIN l ON l.submission_id = m.submission_id AND l.doc_id = m.doc_id AND l.lo = m.lo AND l.hi = m.hi WHERE m.gloss IS NOT NULL GROUP BY ALL)"""


@query("""SELECT submission_id, doc_id, a_lo, a_hi, b_lo, b_hi FROM (SELECT a.submission_id, a.doc_id, a.lo AS a_lo, a.hi AS a_hi, b.lo AS b_lo, b.hi AS b_hi FROM fs a JOIN fs b ON a.submission_id = b.submission_id AND a.doc_id = b.doc_id AND a.sent = b.sent AND (a.lo, a.hi) <> (b.lo, b.hi)
 WHERE a.gloss <> b.gloss AND a.link <> b.link AND (a.t = 'PER' OR (a.t = 'ORG' AND b.t NOT IN ('PER', 'TITLE')))) QUALIFY row_number() OVER (PARTITION BY submission_id, doc_id, least(row(a_lo, a_hi), row(b_lo, b_hi)), greatest(row(a_lo, a_hi), row(b_lo, b_hi)) ORDER BY a_lo, a_hi, b_lo, b_hi) = 1""", "m", "l", "s", more=_LEGACY)
def legacy_pairs(s: SparkSession, d: str) -> DataFrame:
    """Candidate pairs as earlier batches had them: mentions of one first sentence whose texts and links differ."""
    key = ["submission_id", "doc_id"]
    t = load(s, d, "sentence").selectExpr("doc_id", "span.lo AS o_lo", "span.hi AS o_hi").distinct()
    m = k.latest_mentions(s, d).filter("gloss IS NOT NULL").select(*key, "lo", "hi", F.col("mention_type").alias("t"), "gloss")
    m = m.join(k.latest_links(s, d).select(*key, "lo", "hi", F.col("link_name").alias("link")), [*key, "lo", "hi"], "left").withColumn("link", F.coalesce("link", F.lit("")))
    first = ranges.contained_in(m, t, ["doc_id"]).groupBy(*key, "lo", "hi", "t", "gloss", "link").agg(F.min(F.struct("o_lo", "o_hi")).alias("sent"))
    side = lambda x: first.select(*key, "sent", F.struct("lo", "hi").alias(x), F.col("t").alias(f"t{x}"), F.col("gloss").alias(f"g{x}"), F.col("link").alias(f"l{x}"))
    kinds = (F.col("ta") == "PER") | ((F.col("ta") == "ORG") & ~F.col("tb").isin("PER", "TITLE"))
    pairs = side("a").join(side("b"), [*key, "sent"]).filter((F.col("a") != F.col("b")) & (F.col("ga") != F.col("gb")) & (F.col("la") != F.col("lb")) & kinds)
    one = distinct_on(pairs.withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b")}), [*key, "_a", "_b"], [F.col("a"), F.col("b")])
    return one.select(*key, F.col("a.lo").alias("a_lo"), F.col("a.hi").alias("a_hi"), F.col("b.lo").alias("b_lo"), F.col("b.hi").alias("b_hi"))


@query("SELECT doc_id, lo, hi, min(created) AS created, min(mention_type) AS mention_type, round(avg(weight), 6) AS weight, array_to_string(list_sort(list(assignment_id)), ' ') AS assignments FROM r GROUP BY ALL", "r")
def migrated_mentions(s: SparkSession, d: str) -> DataFrame:
    """Facts of a migration, grouped by their key: first time and type, mean weight, all sources."""
    g = k.responses(s, d).groupBy("doc_id", "lo", "hi").agg(F.min("created").alias("created"), F.min("mention_type").alias("mention_type"), F.round(F.avg("weight"), 6).alias("weight"), F.array_join(F.array_sort(F.collect_list("assignment_id")), " ").alias("assignments"))
    return g


@query("SELECT doc_id, lo, hi, c_lo, c_hi FROM (SELECT doc_id, lo, hi, c_lo, c_hi, count(*) AS n FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, lo, hi ORDER BY n DESC, c_lo IS NULL, c_lo, c_hi) = 1", "r")
def majority_elements(s: SparkSession, d: str) -> DataFrame:
    """The canonical span most answers give; nulls count, ties go to the smallest."""
    r = k.responses(s, d).withColumn("canon", F.when(F.col("c_lo").isNotNull(), F.struct("c_lo", "c_hi")))
    return mode_with_nulls(r, ["doc_id", "lo", "hi"], "canon").select("doc_id", "lo", "hi", "mode.c_lo", "mode.c_hi")


@query("SELECT u.name, u.corpus_tag, x.value FROM (SELECT user_id % 40 AS id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts DESC, value DESC) = 1) x JOIN submission u ON u.id = x.id WHERE u.active ORDER BY x.value DESC, u.name LIMIT 20")
def active_leaderboard(s: SparkSession, d: str) -> DataFrame:
    """The latest score of each active submission, best first."""
    scores = latest(load(s, d, "events").withColumn("id", F.col("user_id") % 40), ["id"], "ts", ["value"])
    u = load(s, d, "submission").filter("active").select("id", "name", "corpus_tag")
    return top(scores.join(u, "id").select("name", "corpus_tag", "value"), [F.col("value").desc(), F.col("name")], 20)


@query("SELECT doc_id, subject_lo, object_lo, relation, 1.0::DOUBLE AS label FROM (SELECT v.doc_id, v.subject_lo, v.object_lo, v.relation, sum(v.weight) / max(a.of) AS w FROM k_relvote v JOIN (SELECT doc_id, subject_lo, object_lo, count(DISTINCT assignment_id)::DOUBLE AS of FROM k_relvote GROUP BY ALL) a USING (doc_id, subject_lo, object_lo) GROUP BY v.doc_id, v.subject_lo, v.object_lo, v.relation) WHERE w > 0.5 AND relation <> 'rel:0'", "k_relvote")
def exhaustive_sample(s: SparkSession, d: str) -> DataFrame:
    """Gold relations of sampled documents as instances with label 1; 'rel:0' stands for no relation."""
    from claimscope.plans.evaluation import majority_relation

    return majority_relation(s, d).filter("relation <> 'rel:0'").select("doc_id", "subject_lo", "object_lo", "relation", F.lit(1.0).alias("label"))


# questions


@query("""SELECT batch_id, id, coalesce(kind, 'none') AS kind, CASE WHEN kind = 'exhaustive_mentions' THEN doc ELSE coalesce(kind = 'selective_relations' OR kind = 'exhaustive_relations', false) AND doc AND subject AND object END AS valid FROM (SELECT DISTINCT batch_id, id, json_extract_string(j, '$.batch_type') AS kind, json_extract_string(j, '$.doc_id') IS NOT NULL AS doc,
 json_extract_string(j, '$.subject') IS NOT NULL AS subject, json_extract_string(j, '$.object') IS NOT NULL AS object FROM (SELECT batch_id, id, CASE WHEN json_type(j2) = 'VARCHAR' THEN CAST(j2 ->> '$' AS JSON) ELSE j2 END AS j FROM
 (SELECT batch_id, id, CASE WHEN json_type(params) = 'VARCHAR' AND json_valid(CAST(params AS JSON) ->> '$') THEN CAST(CAST(params AS JSON) ->> '$' AS JSON) ELSE CAST(params AS JSON) END AS j2 FROM evaluation_question WHERE json_valid(params))) WHERE json_type(j) = 'OBJECT')""")
def question_validity(s: SparkSession, d: str) -> DataFrame:
    """Whether the payload of a question has what its kind needs."""
    has = lambda p: F.get_json_object("params", f"$.{p}").isNotNull()
    q = nested.with_object(load(s, d, "evaluation_question"), "params").withColumn("kind", F.coalesce(F.get_json_object("params", "$.batch_type"), F.lit("none")))
    valid = F.when(F.col("kind") == "exhaustive_mentions", has("doc_id")).otherwise(F.col("kind").isin("selective_relations", "exhaustive_relations") & has("doc_id") & has("subject") & has("object"))
    return q.select("batch_id", "id", "kind", valid.alias("valid")).distinct()


@query("""SELECT u.id AS submission_id, count(DISTINCT b.id) AS n_batches, count(DISTINCT p.batch_id) AS n_sampled FROM submission u LEFT JOIN sample_batch b ON b.submission_id = u.id LEFT JOIN submission_sample p ON p.submission_id = u.id AND p.batch_id = b.id GROUP BY u.id""")
def batch_preconditions(s: SparkSession, d: str) -> DataFrame:
    """What a batch of questions needs: sample batches of the submission, and those of them with samples."""
    b = load(s, d, "sample_batch").select("submission_id", F.col("id").alias("batch_id")).dropna().distinct()
    p = load(s, d, "submission_sample").select("submission_id", "batch_id").distinct().withColumn("x", F.lit(1))
    n = b.join(p, ["submission_id", "batch_id"], "left").groupBy("submission_id").agg(F.count(F.lit(1)).alias("n_batches"), F.count("x").alias("n_sampled"))
    return load(s, d, "submission").select(F.col("id").alias("submission_id")).join(n, "submission_id", "left").select("submission_id", F.coalesce("n_batches", F.lit(0)).alias("n_batches"), F.coalesce("n_sampled", F.lit(0)).alias("n_sampled"))


_FLIP = "((s.mention_type = 'ORG' AND o.mention_type = 'PER') OR s.mention_type = 'GPE' AND o.mention_type IN ('PER', 'ORG'))"


@query(f"""SELECT doc_id, CASE WHEN flip THEN b_lo ELSE s_lo END AS s_lo, CASE WHEN flip THEN s_lo ELSE b_lo END AS o_lo FROM (SELECT p.*, {_FLIP} AS flip FROM (SELECT DISTINCT doc_id, s_lo, s_hi, b_lo, b_hi FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, least(row(s_lo, s_hi), row(b_lo, b_hi)), greatest(row(s_lo, s_hi), row(b_lo, b_hi)) ORDER BY s_lo, s_hi, b_lo, b_hi) = 1) p
 JOIN om s ON s.doc_id = p.doc_id AND s.lo = p.s_lo AND s.hi = p.s_hi JOIN om o ON o.doc_id = p.doc_id AND o.lo = p.b_lo AND o.hi = p.b_hi)""", "m", more=_P + ",\nom AS (SELECT doc_id, lo, hi, min(row(mention_type, gloss))[1] AS mention_type FROM m GROUP BY ALL)")
def made_questions(s: SparkSession, d: str) -> DataFrame:
    """Questions for all sampled pairs, none asked yet, each pair once, organisations and places as objects."""
    p = _samples(s, d).select("doc_id", "s_lo", "s_hi", F.col("b_lo").alias("o_lo"), F.col("b_hi").alias("o_hi"))
    asked = s.createDataFrame([], "doc_id string, s_lo int, o_lo int")
    return relation_questions(p, k.latest_mentions(s, d).select("doc_id", "lo", "hi", "mention_type", "gloss"), asked).select("doc_id", "s_lo", "o_lo")


# read models


@query("""SELECT d.id, d.title, count(DISTINCT s.sentence_index) AS n_sentences, coalesce(max(c.n), 0) AS n_mentions FROM (SELECT DISTINCT id, title FROM document) d LEFT JOIN sentence s ON s.doc_id = d.id LEFT JOIN (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id) c ON c.doc_id = d.id GROUP BY d.id, d.title""", "m")
def document_listing(s: SparkSession, d: str) -> DataFrame:
    """Documents with the numbers of their sentences and mentions."""
    t = load(s, d, "document").select("id", "title").distinct()
    n = load(s, d, "sentence").groupBy(F.col("doc_id").alias("id")).agg(F.countDistinct("sentence_index").alias("n_sentences"))
    c = k.latest_mentions(s, d).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n_mentions"))
    return t.join(n, "id", "left").join(c, "id", "left").select("id", "title", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"))


@query("""SELECT p.submission_id, p.doc_id, p.s_lo, p.b_lo, a.mention_type AS subject_type, a.gloss AS subject_gloss, b.mention_type AS object_type, b.gloss AS object_gloss FROM p JOIN m a ON a.submission_id = p.submission_id AND a.doc_id = p.doc_id AND a.lo = p.s_lo AND a.hi = p.s_hi
 JOIN m b ON b.submission_id = p.submission_id AND b.doc_id = p.doc_id AND b.lo = p.b_lo AND b.hi = p.b_hi""", "m", more=_P)
def sampled_pairs_read(s: SparkSession, d: str) -> DataFrame:
    """Sampled pairs with both mentions; pairs that lack one are left out."""
    m = k.latest_mentions(s, d)
    side = lambda p, n: m.select("submission_id", "doc_id", F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"), F.col("mention_type").alias(f"{n}_type"), F.col("gloss").alias(f"{n}_gloss"))
    j = _samples(s, d).join(side("s", "subject"), ["submission_id", "doc_id", "s_lo", "s_hi"]).join(side("b", "object"), ["submission_id", "doc_id", "b_lo", "b_hi"])
    return j.select("submission_id", "doc_id", "s_lo", "b_lo", "subject_type", "subject_gloss", "object_type", "object_gloss")


@query("SELECT p.batch_id, p.submission_id, count(*) AS n, count(DISTINCT p.doc_id) AS n_docs FROM (SELECT DISTINCT batch_id, submission_id, doc_id, subject, \"object\" FROM submission_sample) p GROUP BY ALL")
def sample_listing(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "submission_sample").select("batch_id", "submission_id", "doc_id", "subject", "object").distinct()
    return p.groupBy("batch_id", "submission_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


_GUESS = """gk AS (SELECT DISTINCT doc_id, subject_lo, object_lo, relation FROM k_gold WHERE correct), ik AS (SELECT DISTINCT submission_id, doc_id, subject_lo, object_lo, relation, subject_entity AS entity FROM k_relation),
hit AS (SELECT ik.*, gk.one IS NOT NULL AS ok FROM ik LEFT JOIN (SELECT *, 1 AS one FROM gk) gk USING (doc_id, subject_lo, object_lo, relation))"""


@query("""SELECT submission_id, 'instance' AS kind, round(c / g, 8) AS precision, round(c / t, 8) AS recall, round(CASE WHEN c > 0 THEN 2 * (c / g) * (c / t) / (c / g + c / t) ELSE 0 END, 8) AS f1 FROM (SELECT submission_id, count(*) FILTER (WHERE ok)::DOUBLE AS c, count(*)::DOUBLE AS g, (SELECT count(*) FROM gk)::DOUBLE AS t FROM hit GROUP BY submission_id)
 UNION ALL SELECT submission_id, 'relation', round(avg(p), 8), round(avg(r), 8), round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 8) FROM (SELECT submission_id, relation, count(*) FILTER (WHERE ok) / count(*)::DOUBLE AS p, coalesce(count(*) FILTER (WHERE ok) / nullif((SELECT count(*) FROM gk WHERE gk.relation = hit.relation), 0)::DOUBLE, 0) AS r FROM hit GROUP BY submission_id, relation) GROUP BY submission_id""", "k_relation", "k_gold", more=_GUESS)
def guess_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of each submission's instances against the right gold ones: over all, and the mean over its relations."""
    key = ["doc_id", "subject_lo", "object_lo", "relation"]
    g = k.gold(s, d).filter("correct").select(*key).distinct().withColumn("right", F.lit(1))
    hit = k.relations(s, d).selectExpr("submission_id", *key, "subject_entity AS entity").distinct().join(g, key, "left")
    per = hit.groupBy("submission_id", "relation").agg(F.count("right").alias("c"), F.count(F.lit(1)).alias("g")).join(g.groupBy("relation").agg(F.count(F.lit(1)).alias("t")), "relation", "left")
    p, r = F.col("c") / F.col("g"), F.coalesce(F.try_divide("c", "t"), F.lit(0.0))
    f = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    each = per.select("submission_id", p.alias("precision"), r.alias("recall")).withColumn("f1", f)
    macro = each.groupBy("submission_id").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).withColumn("kind", F.lit("relation"))
    n = g.agg(F.count(F.lit(1)).alias("t"))
    total = per.groupBy("submission_id").agg(F.sum("c").alias("c"), F.sum("g").alias("g")).crossJoin(n)  # one row on the right
    micro = total.select("submission_id", p.alias("precision"), r.alias("recall")).withColumn("f1", f).withColumn("kind", F.lit("instance"))
    return _rounded(micro.unionByName(macro).select("submission_id", "kind", "precision", "recall", "f1"))
