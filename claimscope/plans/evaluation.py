"""Queries of slot-filling scores and of annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions import scalars as sc
from claimscope.operators import annotation as ann
from claimscope.operators import nested
from claimscope.operators import slotfilling as sf
from claimscope.plans.relational import OPENED
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


_G = """g AS (SELECT entity, slot_value, max(eq) AS eq FROM k_run GROUP BY ALL),
o AS (SELECT DISTINCT run_id, entity, slot_value FROM k_run),
lo AS (SELECT run_id, entity, slot_value, coalesce(g.eq, 0) AS eq FROM o LEFT JOIN g USING (entity, slot_value)),
es AS (SELECT run_id, entity, count(*) AS s, count(DISTINCT CASE WHEN eq > 0 THEN eq END) AS c FROM lo GROUP BY ALL),
et AS (SELECT entity, count(DISTINCT CASE WHEN eq > 0 THEN eq END) AS t FROM g GROUP BY entity),
sc AS (SELECT run_id, entity, s, c, t FROM es JOIN et USING (entity)),
mx AS (SELECT run_id, entity, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, p, r FROM (SELECT *, coalesce(c / nullif(s, 0), 0) AS p, coalesce(c / nullif(t, 0), 0) AS r FROM sc))"""


def _scores(s: SparkSession, d: str) -> DataFrame:
    r = k.runs(s, d)
    return sf.entity_scores(r, r, "anydoc")


@query("SELECT entity, slot_value, max(eq) AS eq FROM k_run GROUP BY ALL", "k_run")
def project_gold(s: SparkSession, d: str) -> DataFrame:
    return sf.project_gold(k.runs(s, d), "anydoc")


@query("SELECT run_id, entity, prov, slot_value, max(eq) OVER (PARTITION BY entity, prov, slot_value) AS eq FROM k_run QUALIFY row_number() OVER (PARTITION BY run_id, entity, prov, slot_value) = 1", "k_run")
def project_output(s: SparkSession, d: str) -> DataFrame:
    r = k.runs(s, d)
    return sf.project_output(r, r, "closed-world")


@query("SELECT * FROM sc", "k_run", more=_G)
def entity_scores(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d)


@query("""SELECT run_id, 'micro' AS kind, round(c / s, 8) AS precision, round(c / t, 8) AS recall, round(2 * (c / s) * (c / t) / (c / s + c / t), 8) AS f1 FROM (SELECT run_id, sum(s)::DOUBLE AS s, sum(c)::DOUBLE AS c, sum(t)::DOUBLE AS t FROM sc GROUP BY run_id)
 UNION ALL SELECT run_id, 'macro', round(avg(p), 8), round(avg(r), 8), round(avg(f1), 8) FROM mx GROUP BY run_id""", "k_run", more=_G)
def micro_macro(s: SparkSession, d: str) -> DataFrame:
    x = _scores(s, d)
    both = sf.micro(x).withColumn("kind", F.lit("micro")).unionByName(sf.macro(x).withColumn("kind", F.lit("macro")))
    return both.select("run_id", "kind", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT run_id, entity, round(f1, 8) AS f1 FROM mx", "k_run", more=_G)
def score_matrix(s: SparkSession, d: str) -> DataFrame:
    return sf.score_matrix(_scores(s, d)).withColumn("f1", F.round("f1", 8))


@query("SELECT round(v_system, 8) AS v_system, round(v_topic, 8) AS v_topic, round(v_interaction, 8) AS v_interaction, round(v_total, 8) AS v_total, round(v_system / (v_system + v_topic + v_interaction), 8) AS phi, round(v_system / (v_system + v_interaction), 8) AS rho FROM vc", "k_run", more=_G + """,
vc AS (SELECT (SELECT var_pop(m) FROM (SELECT avg(f1) AS m FROM mx GROUP BY run_id)) AS v_system, (SELECT var_pop(m) FROM (SELECT avg(f1) AS m FROM mx GROUP BY entity)) AS v_topic,
 (SELECT var_pop(f1 - a - b + g) FROM (SELECT f1, avg(f1) OVER (PARTITION BY run_id) AS a, avg(f1) OVER (PARTITION BY entity) AS b, avg(f1) OVER () AS g FROM mx)) AS v_interaction, (SELECT var_pop(f1) FROM mx) AS v_total)""")
def variance_components(s: SparkSession, d: str) -> DataFrame:
    v = sf.variance_components(sf.score_matrix(_scores(s, d)))
    return v.select(*[F.round(c, 8).alias(c) for c in v.columns])


@query("SELECT run_id, round(avg(z), 8) AS z FROM (SELECT run_id, (f1 - avg(f1) OVER w) / CASE WHEN stddev_pop(f1) OVER w = 0 THEN 1 ELSE stddev_pop(f1) OVER w END AS z FROM mx WINDOW w AS (PARTITION BY entity)) GROUP BY run_id", "k_run", more=_G)
def standardized(s: SparkSession, d: str) -> DataFrame:
    return sf.standardised(sf.score_matrix(_scores(s, d))).withColumn("z", F.round("z", 8))


_POOL = """kg AS (SELECT entity, prov, slot_value FROM k_run GROUP BY ALL HAVING max(eq) > 0),
by_team AS (SELECT DISTINCT {team} AS team, entity, prov, slot_value FROM k_run SEMI JOIN kg USING (entity, prov, slot_value)),
n AS (SELECT entity, prov, slot_value, count(*) AS n FROM by_team GROUP BY ALL)"""
_POOL_BODY = "SELECT team, (SELECT count(*) FROM n) - count(*) FILTER (WHERE n = 1) AS n_gold FROM by_team JOIN n USING (entity, prov, slot_value) GROUP BY team"


@query(_POOL_BODY, "k_run", more=_POOL.format(team="run_id"))
def leave_run_out_pool(s: SparkSession, d: str) -> DataFrame:
    r = k.runs(s, d)
    return sf.leave_out_pool(r, r, "closed-world", F.col("run_id"))


@query(_POOL_BODY, "k_run", more=_POOL.format(team="run_id // 2"))
def leave_team_out_pool(s: SparkSession, d: str) -> DataFrame:
    r = k.runs(s, d)
    return sf.leave_out_pool(r, r, "closed-world", F.expr("run_id div 2"))


@query("SELECT round(regr_slope(f, rk), 8) AS slope, round(regr_intercept(f, rk), 8) AS intercept, round(median(f), 8) AS median FROM (SELECT avg(f1) AS f, row_number() OVER (ORDER BY avg(f1), run_id) AS rk FROM mx GROUP BY run_id)", "k_run", more=_G)
def ranked_trend(s: SparkSession, d: str) -> DataFrame:
    f = sf.macro(_scores(s, d)).select("run_id", F.col("f1").alias("f"))
    r = f.selectExpr("f", "row_number() OVER (ORDER BY f, run_id) AS rk")  # one row per run
    return r.agg(F.round(F.regr_slope("f", "rk"), 8).alias("slope"), F.round(F.regr_intercept("f", "rk"), 8).alias("intercept"), F.round(F.median("f"), 8).alias("median"))


# annotation


@query("""SELECT v.doc_id, v.subject_lo, v.object_lo, v.relation, round(sum(v.weight) / a.of, 8) AS weight FROM k_relvote v JOIN (SELECT doc_id, subject_lo, object_lo, count(DISTINCT assignment_id)::DOUBLE AS of FROM k_relvote GROUP BY ALL) a
 ON v.doc_id = a.doc_id AND v.subject_lo = a.subject_lo AND v.object_lo = a.object_lo GROUP BY v.doc_id, v.subject_lo, v.object_lo, v.relation, a.of HAVING sum(v.weight) / a.of > 0.5""", "k_relvote")
def majority_relation(s: SparkSession, d: str) -> DataFrame:
    """Relations that more than half of the expected votes on their arguments hold."""
    v = k.relation_votes(s, d)
    key = ["doc_id", "subject_lo", "object_lo"]
    asked = v.groupBy(*key).agg(F.countDistinct("assignment_id").cast("double").alias("of"))
    return ann.merge_facts(v, key, ["relation"], asked).withColumn("weight", F.round("weight", 8))


@query("SELECT doc_id, lo, hi, mention_type, n, of FROM (SELECT doc_id, lo, hi, mention_type, count(*) AS n FROM r GROUP BY ALL) JOIN (SELECT doc_id, lo, hi, count(*) AS of FROM r GROUP BY ALL) USING (doc_id, lo, hi) WHERE n * 2 > of", "r")
def majority_type(s: SparkSession, d: str) -> DataFrame:
    return ann.merge_votes(k.responses(s, d).select("doc_id", "lo", "hi", "mention_type"), ["doc_id", "lo", "hi"], "mention_type")


@query("SELECT doc_id, lo, hi, c_lo, c_hi, n, of FROM (SELECT doc_id, lo, hi, c_lo, c_hi, count(*) AS n FROM r GROUP BY ALL) JOIN (SELECT doc_id, lo, hi, count(*) AS of FROM r GROUP BY ALL) USING (doc_id, lo, hi) WHERE n * 2 > of AND c_lo IS NOT NULL", "r")
def majority_canonical(s: SparkSession, d: str) -> DataFrame:
    r = k.responses(s, d).withColumn("canon", F.struct("c_lo", "c_hi")).select("doc_id", "lo", "hi", "canon")
    return ann.merge_votes(r, ["doc_id", "lo", "hi"], "canon").select("doc_id", "lo", "hi", "canon.c_lo", "canon.c_hi", "n", "of").filter("c_lo IS NOT NULL")


_ONES = "(SELECT * FROM r WHERE weight = 1)"
_HOLDS = "a.doc_id = b.doc_id AND a.mention_type = b.mention_type AND ((b.lo <= a.lo AND a.hi <= b.hi AND a.lo < a.hi AND NOT (a.lo = b.lo AND a.hi = b.hi)) OR (a.lo = b.lo AND a.hi = b.hi AND a.assignment_id < b.assignment_id))"


@query(f"SELECT a.doc_id, a.mention_type, a.lo, a.hi, count(*) AS pairs, round(0.5 + sqrt(0.25 + 2 * count(*)), 6) AS votes FROM {_ONES} a JOIN {_ONES} b ON {_HOLDS} GROUP BY ALL", "r")
def span_clique_counts(s: SparkSession, d: str) -> DataFrame:
    return ann.span_clique_counts(k.responses(s, d)).withColumn("votes", F.round("votes", 6))


_EXPECTED = """aq AS (SELECT question_batch_id, question_id, count(DISTINCT assignment_id) AS n FROM r GROUP BY ALL),
ev AS (SELECT doc_id, lo, hi, sum(n)::DOUBLE AS of, list_sort(list(DISTINCT question_id)) AS qs, list_sort(list(DISTINCT question_batch_id)) AS bs FROM (SELECT DISTINCT doc_id, lo, hi, question_batch_id, question_id FROM r) JOIN aq USING (question_batch_id, question_id) GROUP BY doc_id, lo, hi)"""
_MERGED = _EXPECTED + f""",
pr AS (SELECT a.doc_id, a.mention_type, a.lo, a.hi, a.gloss, row(a.c_lo, a.c_hi) AS ca, row(b.c_lo, b.c_hi) AS cb FROM {_ONES} a JOIN {_ONES} b ON {_HOLDS}),
pc AS (SELECT doc_id, mention_type, lo, hi, 0.5 + sqrt(0.25 + 2 * count(*)) AS votes FROM pr GROUP BY ALL),
oc AS (SELECT pc.*, of, row_number() OVER (PARTITION BY doc_id ORDER BY lo, hi, votes, mention_type) AS rn FROM pc JOIN ev USING (doc_id, lo, hi)),
st(doc_id, rn, lo, hi, w_lo, w_hi, w_type, w_votes, w_of, win) AS (
 SELECT doc_id, rn, lo, hi, lo, hi, mention_type, votes, of, 1 FROM oc WHERE rn = 1
 UNION ALL SELECT o.doc_id, o.rn, o.lo, o.hi, CASE WHEN t THEN o.lo ELSE w_lo END, CASE WHEN t THEN o.hi ELSE w_hi END, CASE WHEN t THEN o.mention_type ELSE w_type END, CASE WHEN t THEN o.votes ELSE w_votes END, CASE WHEN t THEN o.of ELSE w_of END, CASE WHEN o.lo >= w_hi THEN win + 1 ELSE win END
 FROM (SELECT st.*, o, o.lo >= w_hi OR (o.votes > o.of / 2 AND o.hi - o.lo > w_hi - w_lo) AS t FROM st JOIN oc o ON o.doc_id = st.doc_id AND o.rn = st.rn + 1)),
fw AS (SELECT doc_id, win, max_by(row(w_lo, w_hi, w_type, w_votes, w_of), rn) AS w FROM st GROUP BY doc_id, win),
wn AS (SELECT doc_id, win, w[1] AS lo, w[2] AS hi, w[3] AS mention_type, w[4] / w[5] AS weight FROM fw WHERE w[4] > w[5] / 2),
mp AS (SELECT DISTINCT st.doc_id, row(st.lo, st.hi) AS c, row(wn.lo, wn.hi) AS canon FROM st JOIN wn USING (doc_id, win)),
gl AS (SELECT doc_id, mention_type, lo, hi, gloss FROM (SELECT doc_id, mention_type, lo, hi, gloss, count(*) AS n FROM pr WHERE gloss IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, mention_type, lo, hi ORDER BY n DESC, gloss) = 1),
cc AS (SELECT doc_id, mention_type, lo, hi, unnest([ca, cb]) AS c FROM pr),
cn AS (SELECT doc_id, mention_type, lo, hi, canon FROM (SELECT cc.doc_id, mention_type, lo, hi, canon, count(*) AS n FROM cc LEFT JOIN mp ON mp.doc_id = cc.doc_id AND mp.c = cc.c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, mention_type, lo, hi ORDER BY n DESC, canon NULLS LAST) = 1),
mm AS (SELECT wn.doc_id, wn.lo, wn.hi, mention_type, gloss, coalesce(canon[1], wn.lo) AS c_lo, coalesce(canon[2], wn.hi) AS c_hi, weight FROM wn LEFT JOIN gl USING (doc_id, mention_type, lo, hi) LEFT JOIN cn USING (doc_id, mention_type, lo, hi))"""


@query("SELECT doc_id, lo, hi, mention_type, gloss, c_lo, c_hi, round(weight, 8) AS weight FROM mm", "r", more=_MERGED)
def merged_mentions(s: SparkSession, d: str) -> DataFrame:
    return ann.merge_mentions(k.responses(s, d)).withColumn("weight", F.round("weight", 8))


_LINKS = """lv AS (SELECT doc_id, lo, hi, 'gloss:' || gloss AS link_name, weight >= 0.5 AS correct, assignment_id, question_batch_id, question_id FROM r WHERE gloss IS NOT NULL),
le AS (SELECT doc_id, lo, hi, link_name, sum(n)::DOUBLE AS of FROM (SELECT DISTINCT doc_id, lo, hi, link_name, question_batch_id, question_id FROM lv) JOIN aq USING (question_batch_id, question_id) GROUP BY ALL),
ml AS (SELECT lv.doc_id, lv.lo, lv.hi, lv.link_name, correct, count(*) / of AS weight FROM lv JOIN le ON lv.doc_id = le.doc_id AND lv.lo = le.lo AND lv.hi = le.hi AND lv.link_name = le.link_name GROUP BY lv.doc_id, lv.lo, lv.hi, lv.link_name, correct, of HAVING count(*) / of > 0.5)"""


@query("""SELECT doc_id, lo, hi, link_name, correct, round(weight, 8) AS weight FROM (SELECT * FROM ml UNION ALL SELECT x.doc_id, x.lo, x.hi, 'gloss:' || y.gloss, true, y.weight FROM mm x JOIN mm y ON x.doc_id = y.doc_id AND x.c_lo = y.lo AND x.c_hi = y.hi
 WHERE y.gloss IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ml WHERE ml.doc_id = x.doc_id AND ml.lo = x.lo AND ml.hi = x.hi AND ml.link_name = 'gloss:' || y.gloss))""", "r", more=_MERGED + ",\n" + _LINKS)
def merged_links(s: SparkSession, d: str) -> DataFrame:
    """Links by majority (each answer's gloss as a link), then those to the gloss of the merged canonical mention."""
    r = k.responses(s, d)
    votes = r.filter(F.col("gloss").isNotNull()).select("doc_id", "lo", "hi", F.concat(F.lit("gloss:"), "gloss").alias("link_name"), (F.col("weight") >= 0.5).alias("correct"), "assignment_id", "question_batch_id", "question_id")
    key = ["doc_id", "lo", "hi", "link_name"]
    asked = r.groupBy("question_batch_id", "question_id").agg(F.countDistinct("assignment_id").alias("n"))
    of = votes.select(*key, "question_batch_id", "question_id").distinct().join(asked, ["question_batch_id", "question_id"]).groupBy(*key).agg(F.sum("n").cast("double").alias("of"))
    links = ann.merge_facts(votes.withColumn("weight", F.lit(1.0)), key, ["correct"], of)
    return ann.with_canonical_links(links, ann.merge_mentions(r)).withColumn("weight", F.round("weight", 8))


_MAJ = "mj AS (SELECT doc_id, lo, hi, mention_type AS g FROM (SELECT doc_id, lo, hi, mention_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id, lo, hi) AS of FROM r GROUP BY doc_id, lo, hi, mention_type) WHERE n * 2 > of)"


@query("SELECT worker_id, count(*) AS n, count(*) FILTER (WHERE mention_type <> g) AS disagree, count(*) FILTER (WHERE mention_type <> g) / count(*) > 0.2 AND count(*) FILTER (WHERE mention_type <> g) > 10 AS bad FROM r JOIN mj USING (doc_id, lo, hi) GROUP BY worker_id", "r", more=_MAJ)
def worker_agreement(s: SparkSession, d: str) -> DataFrame:
    return ann.worker_agreement(k.responses(s, d), ["doc_id", "lo", "hi"], "mention_type")


@query("SELECT question_batch_id, question_id, assignment_id, n, round(n / avg(n) OVER w, 6) AS z, n / avg(n) OVER w > 0.5 AS ok FROM (SELECT question_batch_id, question_id, assignment_id, count(*) AS n FROM r GROUP BY ALL) WINDOW w AS (PARTITION BY question_batch_id, question_id)", "r")
def mention_qc(s: SparkSession, d: str) -> DataFrame:
    return ann.mention_counts_check(k.responses(s, d)).withColumn("z", F.round("z", 6))


_KAPPA = """n AS (SELECT doc_id, lo, hi, mention_type, count(*) AS n FROM r GROUP BY ALL), f AS (SELECT doc_id, lo, hi, sum(n) AS raters, sum(n * n)::DOUBLE AS sq FROM n GROUP BY ALL HAVING sum(n) > 1),
pe AS (SELECT raters, sum(c * c)::DOUBLE / (sum(c) * sum(c))::DOUBLE AS pe FROM (SELECT raters, mention_type, sum(n)::DOUBLE AS c FROM n JOIN f USING (doc_id, lo, hi) GROUP BY ALL) GROUP BY raters),
kp AS (SELECT CAST(raters AS BIGINT) AS raters, count(*) AS n_items, (avg((sq - raters) / (raters * (raters - 1))) - max(pe)) / nullif(1 - max(pe), 0) AS kappa FROM f JOIN pe USING (raters) GROUP BY raters)"""


@query("SELECT raters, n_items, round(kappa, 8) AS kappa FROM kp", "r", more=_KAPPA)
def fleiss_kappa(s: SparkSession, d: str) -> DataFrame:
    """Agreement on types, for each number of votes that items have."""
    return ann.fleiss_kappa(k.responses(s, d), ["doc_id", "lo", "hi"], "mention_type").withColumn("kappa", F.round("kappa", 8))


@query("SELECT CAST(sum(n_items) AS BIGINT) AS n_items, round(sum(kappa * n_items) / sum(n_items), 8) AS kappa FROM kp WHERE raters % 2 = 1 AND kappa IS NOT NULL", "r", more=_KAPPA)
def fleiss_kappa_odd(s: SparkSession, d: str) -> DataFrame:
    """Over all odd numbers of raters, weighted by items."""
    return ann.pooled_kappa(ann.fleiss_kappa(k.responses(s, d), ["doc_id", "lo", "hi"], "mention_type")).withColumn("kappa", F.round("kappa", 8))


@query("SELECT batch_id, count(*) FILTER (WHERE state = 'done') AS n, count(*) FILTER (WHERE state = 'done') >= count(*) FILTER (WHERE state NOT IN ('revoked', 'deleted', 'error')) AS complete FROM (SELECT DISTINCT batch_id, id, state FROM evaluation_question) GROUP BY batch_id")
def batch_complete(s: SparkSession, d: str) -> DataFrame:
    q = load(s, d, "evaluation_question").select("batch_id", "id", "state").distinct()
    units = q.groupBy("batch_id").agg(F.count_if(~F.col("state").isin("revoked", "deleted", "error")).alias("wanted"))
    return ann.completeness(q, units, "batch_id", F.col("state") == "done", "wanted")


_SAN = """t AS (SELECT DISTINCT id, gloss AS text FROM document),
u AS (SELECT r.assignment_id, r.doc_id, r.lo, r.hi, r.mention_type, r.gloss, min(row(-(least(r.hi, x.hi) - greatest(r.lo, x.lo)), x.lo, x.hi, x.gloss)) AS best FROM r JOIN (SELECT DISTINCT doc_id, lo, hi, mention_type, gloss FROM m WHERE gloss IS NOT NULL) x
 ON r.doc_id = x.doc_id AND r.mention_type = x.mention_type AND r.lo < x.hi AND x.lo < r.hi AND r.lo < r.hi AND x.lo < x.hi GROUP BY ALL)"""


@query("""SELECT r.assignment_id, r.doc_id, r.lo, r.hi, CASE WHEN t.text IS NULL THEN 'Delete' WHEN r.gloss = x THEN 'Correct' WHEN replace(r.gloss, '``', '"') = replace(replace(replace(x, '&amp;', '&'), '’', ''''), '“', '"') THEN 'Replace gloss'
 WHEN best[4] IS NOT NULL AND length(best[4]) = best[3] - best[2] THEN 'Replace with suggested' ELSE 'Replace gloss' END AS action
 FROM (SELECT r.*, t.text, substring(t.text, r.lo + 1, r.hi - r.lo) AS x FROM r LEFT JOIN t ON r.doc_id = t.id) r JOIN (SELECT 1) ON true LEFT JOIN u ON r.assignment_id = u.assignment_id AND r.doc_id = u.doc_id AND r.lo = u.lo AND r.hi = u.hi, LATERAL (SELECT r.text) t""", "r", "m", more=_SAN)
def sanitised_glosses(s: SparkSession, d: str) -> DataFrame:
    from claimscope.operators import ranges

    r = k.responses(s, d).select("assignment_id", "doc_id", "lo", "hi", "mention_type", "gloss")
    m = k.latest_mentions(s, d).filter(F.col("gloss").isNotNull()).select("doc_id", F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), "mention_type", F.col("gloss").alias("s_gloss")).distinct()
    key = ["assignment_id", "doc_id", "lo", "hi"]
    best = ranges.overlapping(r, m, ["doc_id", "mention_type"]).groupBy(*key).agg(F.min(F.struct(-ranges.overlap_length(*map(F.col, ("lo", "hi", "o_lo", "o_hi"))), "o_lo", "o_hi", "s_gloss")).alias("b"))
    t = load(s, d, "document").select(F.col("id").alias("doc_id"), F.col("gloss").alias("text")).distinct()
    j = r.join(t, "doc_id", "left").join(best, key, "left")
    under = sc.under_span(F.col("text"), F.lit(0), F.col("lo"), F.col("hi"))
    return j.select(*key, ann.sanitised(F.col("gloss"), under, F.col("b.s_gloss"), F.col("b.o_lo"), F.col("b.o_hi")).alias("action"))


@query("""SELECT DISTINCT batch_id, id, role, lo, hi, gloss, mention_type, link FROM (SELECT batch_id, id, role, TRY_CAST(coalesce(json_extract_string(params, '$.' || role || '.span[0]'), json_extract_string(params, '$.' || old || '[1]')) AS INT) AS lo, TRY_CAST(coalesce(json_extract_string(params, '$.' || role || '.span[1]'), json_extract_string(params, '$.' || old || '[2]')) AS INT) AS hi,
 json_extract_string(params, '$.' || role || '.gloss') AS gloss, coalesce(json_extract_string(params, '$.' || role || '.type.name'), json_extract_string(params, '$.' || role || '.type')) AS mention_type, json_extract_string(params, '$.' || role || '.entity.link') AS link
 FROM oq, (VALUES ('subject', 'mention_1'), ('object', 'mention_2')) v(role, old)) WHERE lo < hi""", more=OPENED)
def question_arguments(s: SparkSession, d: str) -> DataFrame:
    q = nested.with_object(load(s, d, "evaluation_question"), "params")
    return ann.question_arguments(q)


@query("""SELECT DISTINCT batch_id, id, lo, hi, gloss, mention_type, link FROM (SELECT batch_id, id, TRY_CAST(x ->> '$.doc_char_begin' AS INT) AS lo, TRY_CAST(x ->> '$.doc_char_end' AS INT) AS hi, x ->> '$.gloss' AS gloss, coalesce(x ->> '$.type.name', x ->> '$.type') AS mention_type, x ->> '$.entity.link' AS link
 FROM (SELECT batch_id, id, unnest(CAST(params AS JSON) -> '$.mentions[*]') AS x FROM oq)) WHERE lo < hi""", more=OPENED)
def exhaustive_mentions(s: SparkSession, d: str) -> DataFrame:
    q = nested.with_object(load(s, d, "evaluation_question"), "params")
    return ann.exhaustive_mentions(q).distinct()


@query("""SELECT submission_id, doc_id, s_lo, s_hi, b_lo, b_hi, sha1('{"doc_id": "' || doc_id || '", "object": [' || b_lo || ', ' || b_hi || '], "subject": [' || s_lo || ', ' || s_hi || ']}') AS id FROM
 (SELECT DISTINCT submission_id, doc_id, subject.lo AS s_lo, subject.hi AS s_hi, "object".lo AS b_lo, "object".hi AS b_hi FROM submission_sample)""")
def question_ids(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "submission_sample").selectExpr("submission_id", "doc_id", "subject.lo AS s_lo", "subject.hi AS s_hi", "object.lo AS b_lo", "object.hi AS b_hi").distinct()
    parts = [F.format_string('"doc_id": "%s"', "doc_id"), F.format_string('"object": [%d, %d]', "b_lo", "b_hi"), F.format_string('"subject": [%d, %d]', "s_lo", "s_hi")]
    return p.withColumn("id", sc.question_id(*parts))
