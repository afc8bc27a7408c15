"""Queries of distributions, draws and estimators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.operators import distributions as dist
from claimscope.operators import estimators as est
from claimscope.operators import views
from claimscope.plans.relational import MATCHES
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


_U = "((CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) + 1) / 4503599627370497.0::DOUBLE)"
_STAT = """st AS (SELECT submission_id, subject_entity, relation, CASE WHEN min(object_type) IN ('PER', 'ORG', 'GPE') THEN object_entity ELSE 'STRING' END AS object_entity, count(*) AS n
 FROM k_relation r GROUP BY submission_id, subject_entity, relation, r.object_entity),
rc AS (SELECT submission_id, relation, sum(n) AS n FROM st GROUP BY ALL), ec AS (SELECT submission_id, subject_entity, sum(n) AS n FROM st GROUP BY ALL),
erc AS (SELECT submission_id, subject_entity, count(DISTINCT object_entity) AS n FROM st GROUP BY ALL),
"""
_DER = _STAT + """raw AS (SELECT r.*, erc.n::DOUBLE / ec.n::DOUBLE / rc.n::DOUBLE AS v FROM k_relation r JOIN rc USING (submission_id, relation) JOIN ec USING (submission_id, subject_entity) JOIN erc USING (submission_id, subject_entity)),
pd AS (SELECT *, v / sum(v) OVER (PARTITION BY submission_id) AS p FROM raw)"""
_COLS = ["submission_id", "doc_id", "subject_lo", "object_lo", "relation", "subject_entity", "object_entity"]


@query("SELECT corpus_tag, doc_id, round(1.0 / count(*) OVER (PARTITION BY corpus_tag), 9) AS p FROM (SELECT DISTINCT corpus_tag, doc_id FROM documents WHERE corpus_tag IS NOT NULL)")
def doc_uniform(s: SparkSession, d: str) -> DataFrame:
    t = load(s, d, "documents").filter(F.col("corpus_tag").isNotNull()).select("corpus_tag", F.col("doc_id").alias("id"))
    return dist.document_uniform(t, "corpus_tag").select("corpus_tag", F.col("id").alias("doc_id"), F.round("p", 9).alias("p"))


def _shown(df: DataFrame) -> DataFrame:
    return df.groupBy("submission_id", "relation", "subject_entity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 9).alias("p"))


_SHOW = "SELECT submission_id, relation, subject_entity, count(*) AS n, round(sum(p), 9) AS p FROM x GROUP BY ALL"


@query(_SHOW, "k_relation", more="x AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY submission_id) AS p FROM k_relation)")
def dist_instance(s: SparkSession, d: str) -> DataFrame:
    return _shown(dist.instance(k.relations(s, d)))


@query(_SHOW, "k_relation", more="n AS (SELECT submission_id, relation, count(*) AS c, count(*) OVER (PARTITION BY submission_id) AS g FROM k_relation GROUP BY submission_id, relation), x AS (SELECT r.*, 1.0::DOUBLE / c / g AS p FROM k_relation r JOIN n USING (submission_id, relation))")
def dist_relation(s: SparkSession, d: str) -> DataFrame:
    return _shown(dist.relation(k.relations(s, d)))


@query(_SHOW, "k_relation", more="n AS (SELECT submission_id, subject_entity, count(*) AS c, count(*) OVER (PARTITION BY submission_id) AS g FROM k_relation GROUP BY submission_id, subject_entity), x AS (SELECT r.*, 1.0::DOUBLE / c / g AS p FROM k_relation r JOIN n USING (submission_id, subject_entity))")
def dist_entity(s: SparkSession, d: str) -> DataFrame:
    return _shown(dist.entity(k.relations(s, d)))


def entity_relation_distribution(s: SparkSession, d: str) -> DataFrame:
    r = k.relations(s, d)
    st = views.statistics(r)
    return dist.entity_relation(r, views.relation_counts(st), views.entity_counts(st), views.entity_relation_counts(st))


@query("SELECT submission_id, relation, subject_entity, count(*) AS n, round(sum(p), 9) AS p FROM pd GROUP BY ALL", "k_relation", more=_DER)
def dist_entity_relation(s: SparkSession, d: str) -> DataFrame:
    return _shown(entity_relation_distribution(s, d))


@query("SELECT relation, round(sum(p), 9) AS mass FROM pd GROUP BY relation", "k_relation", more=_DER)
def relation_mass(s: SparkSession, d: str) -> DataFrame:
    return entity_relation_distribution(s, d).groupBy("relation").agg(F.round(F.sum("p"), 9).alias("mass"))


@query("SELECT submission_id, round(sum(p), 6) AS total FROM pd GROUP BY ALL HAVING abs(sum(p) - 1) > 1e-6", "k_relation", more=_DER)
def audit_distribution(s: SparkSession, d: str) -> DataFrame:
    from claimscope.operators.audits import unnormalised

    return unnormalised(entity_relation_distribution(s, d), ["submission_id"], "p").withColumn("total", F.round("total", 6))


@query("SELECT doc_id, round(hits / sum(hits) OVER ()::DOUBLE, 9) AS p FROM (SELECT doc_id, count(*)::DOUBLE AS hits FROM mt GROUP BY doc_id)", more=MATCHES)
def document_entity(s: SparkSession, d: str) -> DataFrame:
    from claimscope.plans.relational import text_match

    hits = text_match(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("p"))
    return dist.normalised(hits, []).select("doc_id", F.round("p", 9).alias("p"))


_INST = "i AS (SELECT submission_id, subject_entity, relation, object_entity, count(*) AS n FROM k_relation GROUP BY ALL)"


def _instances(s: SparkSession, d: str) -> DataFrame:
    return k.relations(s, d).groupBy("submission_id", "subject_entity", "relation", "object_entity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT submission_id, subject_entity, relation, object_entity, row_number() OVER (PARTITION BY submission_id ORDER BY key, subject_entity, relation, object_entity) AS rank FROM
 (SELECT *, -ln({_U.format(key="'w|' || submission_id || '|' || subject_entity || '|' || relation || '|' || object_entity")}) / n AS key FROM i) QUALIFY rank <= 100""", "k_relation", more=_INST)
def wsample_hash(s: SparkSession, d: str) -> DataFrame:
    ids = ["submission_id", "subject_entity", "relation", "object_entity"]
    return dist.draw_without_replacement(_instances(s, d), ["submission_id"], ids, "n", 100, "w").select(*ids, "rank")


@query()
def wsample_with_replacement(s: SparkSession, d: str) -> DataFrame:
    ids = ["submission_id", "subject_entity", "relation", "object_entity"]
    return dist.draw_with_replacement(_instances(s, d).withColumn("p", F.col("n").cast("double")), ids, "p", 500, "r")


@query(f"""SELECT x.doc_id, draw FROM (SELECT g AS draw, least(floor({_U.format(key="'u|' || g")} * (SELECT count(*) FROM x0)), (SELECT count(*) - 1 FROM x0)) AS pos FROM range(1, 501) t(g)) JOIN x ON x.pos = t_pos""".replace("t_pos", "CAST(_.pos AS BIGINT)").replace("FROM range(1, 501) t(g))", "FROM range(1, 501) t(g)) _"),
       more="x0 AS (SELECT DISTINCT doc_id FROM documents), x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM x0)")
def uniform_with_replacement(s: SparkSession, d: str) -> DataFrame:
    return dist.draw_uniformly_with_replacement(load(s, d, "documents"), ["doc_id"], 500, "u")


@query("""SELECT a.submission_id, round(sum(a.p * ln(a.p / b.p)), 9) AS kl FROM (SELECT submission_id, relation, n / sum(n) OVER (PARTITION BY submission_id) AS p FROM (SELECT submission_id, relation, count(*)::DOUBLE AS n FROM k_relation GROUP BY submission_id, relation)) a
 JOIN (SELECT relation, n / sum(n) OVER () AS p FROM (SELECT relation, count(*)::DOUBLE AS n FROM k_relation GROUP BY relation)) b USING (relation) GROUP BY a.submission_id""", "k_relation")
def kl_divergence(s: SparkSession, d: str) -> DataFrame:
    """Of each submission's relations from those of all submissions."""
    n = k.relations(s, d).groupBy("submission_id", "relation").agg(F.count(F.lit(1)).alias("p"))
    q = dist.normalised(n.groupBy("relation").agg(F.sum("p").alias("p")), [])
    return dist.kl_divergence(dist.normalised(n, ["submission_id"]), q, ["relation"], ["submission_id"]).withColumn("kl", F.round("kl", 9))


@query("SELECT submission_id, round(ln(sum(n)), 9) AS log_z, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 9) AS entropy FROM (SELECT submission_id, subject_entity, count(*)::DOUBLE AS n FROM k_relation GROUP BY ALL) GROUP BY submission_id", "k_relation")
def entity_entropy(s: SparkSession, d: str) -> DataFrame:
    n = k.relations(s, d).groupBy("submission_id", "subject_entity").agg(F.count(F.lit(1)).alias("n"))
    return dist.entropy(n, ["submission_id"], "n").select("submission_id", F.round("log_z", 9).alias("log_z"), F.round("entropy", 9).alias("entropy"))


@query(f"""SELECT submission_id, relation, subject_entity, object_entity FROM (SELECT *, {_U.format(key="'s|' || submission_id || '|' || relation || '|' || subject_entity || '|' || object_entity")} AS u FROM i)
 QUALIFY row_number() OVER (PARTITION BY submission_id, relation ORDER BY u, subject_entity, object_entity) <= 10""", "k_relation", more=_INST)
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    i = _instances(s, d)
    u = dist.uniform("s", *map(F.col, ("submission_id", "relation", "subject_entity", "object_entity")))
    w = Window.partitionBy("submission_id", "relation").orderBy("u", "subject_entity", "object_entity")
    return i.withColumn("u", u).withColumn("rn", F.row_number().over(w)).filter("rn <= 10").select("submission_id", "relation", "subject_entity", "object_entity")


# estimators: systems are submissions, instances are entity-relation triples with a deterministic nullable label

_LABEL = "CASE WHEN (e + o) % 7 = 0 THEN NULL WHEN (e * o) % 3 = 0 THEN 0 ELSE 1 END"
_EST = f"""b AS (SELECT submission_id AS i, subject_entity || '|' || relation || '|' || object_entity AS x, CAST(substr(subject_entity, 2) AS INT) AS e, CAST(substr(object_entity, 2) AS INT) AS o, count(*) AS n FROM k_relation GROUP BY ALL),
pp AS (SELECT i, x, n / sum(n) OVER (PARTITION BY i)::DOUBLE AS p FROM b),
p0 AS (SELECT x, 1.0::DOUBLE + max(e) % 3 AS p0 FROM b GROUP BY x),
xh AS (SELECT i AS j, x, {_LABEL} AS f FROM b QUALIFY row_number() OVER (PARTITION BY i ORDER BY -ln({_U.format(key="'x|' || i || '|' || x")}) / n, x) <= 400),
lab AS (SELECT DISTINCT x, {_LABEL} AS f FROM b),
yy AS (SELECT s.i, a.x, CASE WHEN b2.x IS NULL THEN 0 ELSE 1 END AS g FROM (SELECT DISTINCT i FROM b) s, (SELECT x FROM lab WHERE f = 1) a LEFT JOIN (SELECT DISTINCT i, x FROM b) b2 ON b2.i = s.i AND b2.x = a.x)"""
_W = """,
nj AS (SELECT j, count(f) AS n FROM xh GROUP BY j),
wr AS (SELECT a.i, c.i AS j, sum(a.p * c.p) * max(n) AS w FROM pp a JOIN pp c USING (x) JOIN nj ON nj.j = c.i GROUP BY a.i, c.i),
ww AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w, sum(w) OVER (PARTITION BY i) AS z FROM wr),
qq AS (SELECT ww.i, pp.x, sum(w * p) AS q FROM ww JOIN pp ON pp.i = ww.j GROUP BY ww.i, pp.x),
sm AS (SELECT ww.i, ww.j, xh.x, f, w, coalesce(p, 0) AS p, q FROM xh JOIN ww ON xh.j = ww.j JOIN qq ON qq.i = ww.i AND qq.x = xh.x LEFT JOIN pp ON pp.i = ww.i AND pp.x = xh.x WHERE f IS NOT NULL)"""


def _tables(s: SparkSession, d: str):
    b = k.relations(s, d).groupBy(F.col("submission_id").alias("i"), "subject_entity", "relation", "object_entity").agg(F.count(F.lit(1)).alias("n"))
    b = b.select("i", F.concat_ws("|", "subject_entity", "relation", "object_entity").alias("x"), F.expr("CAST(substr(subject_entity, 2) AS INT)").alias("e"), F.expr("CAST(substr(object_entity, 2) AS INT)").alias("o"), "n").withColumn("f", F.expr(_LABEL))
    P = dist.normalised(b.select("i", "x", F.col("n").alias("p")), ["i"])
    P0 = b.groupBy("x").agg((1.0 + F.max("e") % 3).alias("p0"))
    X = dist.draw_without_replacement(b, ["i"], ["i", "x"], "n", 400, "x").select(F.col("i").alias("j"), "x", "f")
    L = b.select("x", "f").distinct()
    Y = b.filter("f = 1").select("i", "x").distinct().withColumn("g", F.lit(1))  # what no system states has no row
    return P, P0, X, Y, L


def _truth(L: DataFrame) -> DataFrame:
    return L.filter("f = 1").select("x")


def _rounded(df: DataFrame, n: int = 8) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("""SELECT i, round(p, 8) AS precision, round(r, 8) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 8) AS f1 FROM
 (SELECT i, coalesce(sum(p * f), 0) AS p FROM pp JOIN lab USING (x) GROUP BY i) JOIN (SELECT i, coalesce(sum(CASE WHEN g = 1 THEN p0 END), 0) / sum(p0) AS r FROM yy JOIN p0 USING (x) GROUP BY i) USING (i)""", "k_relation", more=_EST)
def weighted_pr(s: SparkSession, d: str) -> DataFrame:
    P, P0, X, Y, L = _tables(s, d)
    return _rounded(est.weighted(P, L, P0, Y))


_SIMPLE = "sp AS (SELECT j AS i, avg(f) AS p FROM xh GROUP BY j), sr AS (SELECT i, sum(p0 * g) / sum(p0) AS r FROM yy JOIN p0 USING (x) GROUP BY i)"
_PRF = "SELECT i, round(p, 8) AS precision, round(r, 8) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 8) AS f1 FROM "


@query(_PRF + "sp JOIN sr USING (i)", "k_relation", more=_EST + ",\n" + _SIMPLE)
def simple_pr(s: SparkSession, d: str) -> DataFrame:
    P, P0, X, Y, L = _tables(s, d)
    return _rounded(est.simple(X, P0, Y, _truth(L)))


@query("SELECT i, j, round(w, 8) AS w, round(z, 8) AS z FROM ww", "k_relation", more=_EST + _W)
def weights_heuristic(s: SparkSession, d: str) -> DataFrame:
    P, _, X, _, _ = _tables(s, d)
    return _rounded(est.weights(P, X))


@query("SELECT i, j, round(n / sum(n) OVER (PARTITION BY i), 8) AS w FROM (SELECT DISTINCT i FROM pp), nj", "k_relation", more=_EST + _W)
def weights_size(s: SparkSession, d: str) -> DataFrame:
    P, _, X, _, _ = _tables(s, d)
    return _rounded(est.weights(P, X, "size")).drop("z")


@query("SELECT i, j, round(1.0::DOUBLE / count(*) OVER (PARTITION BY i), 8) AS w FROM (SELECT DISTINCT i FROM pp), nj", "k_relation", more=_EST + _W)
def weights_uniform(s: SparkSession, d: str) -> DataFrame:
    P, _, X, _, _ = _tables(s, d)
    return _rounded(est.weights(P, X, "uniform")).drop("z")


@query("SELECT i, x, round(q, 10) AS q FROM qq", "k_relation", more=_EST + _W)
def proposal(s: SparkSession, d: str) -> DataFrame:
    P, _, X, _, _ = _tables(s, d)
    return _rounded(est.proposal(est.weights(P, X), P), 10)


_JP = "jp AS (SELECT i, sum(w * m) AS p FROM (SELECT i, j, max(w) AS w, avg(p / q * f) AS m FROM sm GROUP BY i, j) GROUP BY i)"
_NU = "nu AS (SELECT i, coalesce(sum(w * a) / nullif(sum(w * b), 0), 0) AS nu FROM (SELECT i, j, max(w) AS w, avg(p0 / q * CASE WHEN f > 0 AND p > 0 THEN 1 ELSE 0 END) AS a, avg(p0 / q * CASE WHEN f > 0 THEN 1 ELSE 0 END) AS b FROM sm JOIN p0 USING (x) GROUP BY i, j) GROUP BY i)"
_TH = "th AS (SELECT sum(p0 * g) / sum(p0) AS theta FROM (SELECT x, max(g) AS g FROM yy GROUP BY x) JOIN p0 USING (x))"


@query("SELECT i, round(p, 8) AS precision FROM jp", "k_relation", more=_EST + _W + ",\n" + _JP)
def joint_precision(s: SparkSession, d: str) -> DataFrame:
    P, _, X, _, _ = _tables(s, d)
    W = est.weights(P, X)
    return _rounded(est.joint_precision(P, X, W, est.proposal(W, P)))


@query("SELECT i, round(nu, 8) AS nu FROM nu", "k_relation", more=_EST + _W + ",\n" + _NU)
def pooled_recall(s: SparkSession, d: str) -> DataFrame:
    P, P0, X, _, _ = _tables(s, d)
    W = est.weights(P, X)
    return _rounded(est.pooled_recall(P0, P, X, W, est.proposal(W, P)))


@query("SELECT round(theta, 8) AS theta FROM th", "k_relation", more=_EST + ",\n" + _TH)
def pool_recall(s: SparkSession, d: str) -> DataFrame:
    _, P0, _, Y, L = _tables(s, d)
    return _rounded(est.pool_recall(P0, Y, _truth(L)))


@query(_PRF + "(SELECT jp.i, p, theta * nu AS r FROM jp JOIN nu USING (i), th)", "k_relation", more=_EST + _W + ",\n" + ",\n".join((_JP, _NU, _TH)))
def joint_score(s: SparkSession, d: str) -> DataFrame:
    P, P0, X, Y, L = _tables(s, d)
    return _rounded(est.joint(P, P0, X, Y, truth=_truth(L)))


@query("SELECT i, round(sum(w * w / c * (s2 - m * m)), 10) AS variance FROM (SELECT i, j, max(w) AS w, avg((p * f / q) * (p * f / q)) AS s2, avg(p * f / q) AS m FROM sm GROUP BY i, j) JOIN (SELECT j, count(*) AS c FROM xh GROUP BY j) USING (j) GROUP BY i", "k_relation", more=_EST + _W)
def joint_variance(s: SparkSession, d: str) -> DataFrame:
    P, _, X, _, _ = _tables(s, d)
    W = est.weights(P, X)
    return _rounded(est.variance(P, X, W, est.proposal(W, P)), 10)


@query(f"""SELECT j, round(avg_f, 8) AS precision, round(lo, 8) AS low, round(hi, 8) AS high FROM (SELECT j, avg(f) AS avg_f FROM xh WHERE f IS NOT NULL GROUP BY j) JOIN
 (SELECT j, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM (SELECT j, epoch, sum(c * f)::DOUBLE / nullif(sum(c), 0)::DOUBLE AS v FROM
 (SELECT j, f, epoch, CASE WHEN u > 0.9994058151824183 THEN 6 WHEN u > 0.9963401531726563 THEN 5 WHEN u > 0.9810118431238462 THEN 4 WHEN u > 0.9196986029286058 THEN 3 WHEN u > 0.7357588823428847 THEN 2 WHEN u > 0.36787944117144233 THEN 1 ELSE 0 END AS c
 FROM (SELECT j, f, epoch, {_U.format(key="'b|' || j || '|' || x || '|' || epoch")} AS u FROM xh, range(1, 201) t(epoch) WHERE f IS NOT NULL)) GROUP BY j, epoch) GROUP BY j) USING (j)""", "k_relation", more=_EST)
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    _, _, X, _, _ = _tables(s, d)
    return _rounded(est.bootstrap_precision(X, 200, "b"))


@query("SELECT i, x, CAST(max(g) AS INT) AS g FROM (SELECT 0 AS i, x, g FROM yy) GROUP BY ALL", "k_relation", more=_EST)
def merged_gold(s: SparkSession, d: str) -> DataFrame:
    _, _, _, Y, L = _tables(s, d)
    return est.merged_labels(Y, _truth(L)).select(F.lit(0).alias("i"), "x", "g")


@query("""SELECT submission_id, round(avg(r), 8) AS macro_recall FROM (SELECT b.submission_id, k, count(*) FILTER (WHERE g.relation = b.relation) / count(*)::DOUBLE AS r FROM (SELECT submission_id, doc_id, subject_lo, object_lo, relation, subject_entity AS k FROM k_relation) b
 JOIN k_gold g USING (doc_id, subject_lo, object_lo) GROUP BY ALL) GROUP BY submission_id""", "k_relation", "k_gold")
def macro_by_entity(s: SparkSession, d: str) -> DataFrame:
    j = k.relations(s, d).join(k.gold(s, d).select("doc_id", "subject_lo", "object_lo", F.col("relation").alias("g")), ["doc_id", "subject_lo", "object_lo"])
    per = j.groupBy("submission_id", "subject_entity").agg((F.count_if(F.col("g") == F.col("relation")) / F.count(F.lit(1))).alias("r"))
    return per.groupBy("submission_id").agg(F.round(F.avg("r"), 8).alias("macro_recall"))


_SIZES = """,
cn AS (SELECT j, count(f) AS labels, count(*) AS n_j FROM xh GROUP BY j),
s2 AS (SELECT a.i, c.i AS j, sum(a.p * c.p) AS s FROM pp a JOIN pp c USING (x) GROUP BY a.i, c.i),
rw AS (SELECT s2.i, s2.j, s * labels AS r, labels, n_j FROM s2 JOIN cn USING (j) WHERE s2.i <> s2.j AND labels > 0),
sy AS (SELECT i, s AS own, coalesce((SELECT sum(r) FROM rw WHERE rw.i = s2.i), 0) AS z FROM s2 WHERE i = j),
mx AS (SELECT rw.i, pp.x, sum(r * p) AS mix FROM rw JOIN pp ON pp.i = rw.j GROUP BY rw.i, pp.x),
bs AS (SELECT pp.i, pp.x, pp.p, coalesce(mix, 0) AS mix, own, z FROM pp LEFT JOIN mx ON mx.i = pp.i AND mx.x = pp.x JOIN sy ON sy.i = pp.i WHERE pp.p > 0),
ow AS (SELECT bs.i, n, pow(max(n * own / (z + n * own)), 2) / n * sum(p * pow(p / ((mix + n * own * p) / (z + n * own)), 2)) AS mine FROM bs JOIN sz ON sz.i = bs.i GROUP BY bs.i, n),
tj AS (SELECT bs.i, rw.j, n, labels, n_j, r / (z + n * own) AS w, bs.p * f / ((mix + n * own * bs.p) / (z + n * own)) AS t FROM xh JOIN rw ON rw.j = xh.j JOIN bs ON bs.i = rw.i AND bs.x = xh.x JOIN sz ON sz.i = bs.i WHERE f <> 0),
rs AS (SELECT i, n, sum(w * w / n_j * (q2 / labels - (q1 / labels) * (q1 / labels))) AS rest FROM (SELECT i, j, n, max(w) AS w, max(labels) AS labels, max(n_j) AS n_j, sum(t * t) AS q2, sum(t) AS q1 FROM tj GROUP BY i, j, n) GROUP BY i, n),
vs AS (SELECT ow.i, ow.n, mine + coalesce(rest, 0) AS variance FROM ow LEFT JOIN rs ON rs.i = ow.i AND rs.n = ow.n)"""


@query("SELECT i, CAST(n AS INT) AS n, round(variance, 10) AS variance FROM vs", "k_relation", more=_EST + ",\nsz AS (SELECT j AS i, count(*) AS n FROM xh GROUP BY j)" + _SIZES)
def conservative_variance(s: SparkSession, d: str) -> DataFrame:
    P, _, X, _, _ = _tables(s, d)
    return _rounded(est.conservative_variance(P, X), 10)


@query("""SELECT i, CAST(n AS INT) AS n FROM (SELECT i, CASE WHEN (SELECT variance FROM vs WHERE vs.i = st.i AND vs.n = 500) >= 1 / 500.0 THEN 500 ELSE hi END AS n FROM st WHERE step = 9)""", "k_relation", more=_EST + ",\nsz AS (SELECT i, n FROM (SELECT DISTINCT i FROM pp), range(1, 501) t(n))" + _SIZES + """,
st(i, lo, hi, step) AS (SELECT DISTINCT i, 1, 500, 0 FROM pp UNION ALL SELECT st.i, CASE WHEN hi - lo <= 1 THEN lo WHEN abs(v) <= 5e-4 OR v > 0 THEN mid ELSE lo END, CASE WHEN hi - lo <= 1 THEN hi WHEN abs(v) <= 5e-4 OR v < 0 THEN mid ELSE hi END, step + 1
 FROM (SELECT st.*, (lo + hi) // 2 AS mid, (SELECT variance FROM vs WHERE vs.i = st.i AND vs.n = (lo + hi) // 2) - 1 / 500.0 AS v FROM st) st WHERE step < 9)""")
def sample_sizes(s: SparkSession, d: str) -> DataFrame:
    """Samples each system needs as the newest one, so that its joint precision is as sure as from 500 samples of its own."""
    P, _, X, _, _ = _tables(s, d)
    return est.sample_sizes(est.variance_by_size(P, X, 500), 500)


@query("SELECT i, j, round(w, 8) AS w, round(z, 8) AS z FROM ww", "k_relation", more=_EST + _W)
def weights_incremental(s: SparkSession, d: str) -> DataFrame:
    """The heuristic weights after the newest system (4) came to the others."""
    P, _, X, _, _ = _tables(s, d)
    old = est.weights(P.filter("i < 4"), X.filter("j < 4"))
    return _rounded(est.updated_weights(old, P, X, 4))


@query("SELECT i, x, round(q, 10) AS q FROM qq", "k_relation", more=_EST + _W)
def proposal_incremental(s: SparkSession, d: str) -> DataFrame:
    P, _, X, _, _ = _tables(s, d)
    old = est.weights(P.filter("i < 4"), X.filter("j < 4"))
    new = est.updated_weights(old, P, X, 4)
    return _rounded(est.updated_proposal(est.proposal(old, P.filter("i < 4")), old, new, P, 4), 10)


_EPOCHS = 50
_CI = ", ".join(f"round(quantile_cont({c}, {q}), 7) AS {n}_{e}" for c, n in (("p", "precision"), ("r", "recall"), ("CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END", "f1")) for e, q in (("low", 0.1), ("high", 0.9)))


def _redraw(seed: str) -> str:
    """Draws of samples (md) and of labelled instances (kd) by the hashes that the operators use."""
    return f""",
px AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY x) - 1 AS pos, count(*) OVER (PARTITION BY j) AS tot FROM xh),
md AS (SELECT j, epoch, pos, count(*) AS k FROM (SELECT j, epoch, CAST(least(floor({_U.format(key=f"'{seed}|' || j || '|' || epoch || '|' || pos")} * tot), tot - 1) AS BIGINT) AS pos FROM px, range(1, {_EPOCHS + 1}) t(epoch)) GROUP BY ALL),
ty AS (SELECT x, g, p0, row_number() OVER (ORDER BY x) - 1 AS pos, count(*) OVER () AS tot FROM (SELECT x, max(g) AS g FROM yy GROUP BY x) JOIN p0 USING (x)),
kd AS (SELECT epoch, pos, count(*) AS k FROM (SELECT epoch, CAST(least(floor({_U.format(key=f"'{seed}Y|' || epoch || '|' || pos")} * tot), tot - 1) AS BIGINT) AS pos FROM ty, range(1, {_EPOCHS + 1}) t(epoch)) GROUP BY ALL)"""


_BASE = "SELECT b.i, round(b.p, 7) AS precision, round(b.r, 7) AS recall, round(CASE WHEN b.p + b.r > 0 THEN 2 * b.p * b.r / (b.p + b.r) ELSE 0 END, 7) AS f1, c.* EXCLUDE (i) FROM "


@query(_BASE + f"(SELECT i, p, r FROM sp JOIN sr USING (i)) b JOIN (SELECT i, {_CI} FROM dr GROUP BY i) c ON b.i = c.i", "k_relation", more=_EST + ",\n" + _SIMPLE + _redraw("si") + """,
dr AS (SELECT a.i, a.p, coalesce(h.s, 0) / e.s AS r FROM (SELECT j AS i, epoch, sum(k * f)::DOUBLE / sum(k)::DOUBLE AS p FROM px JOIN md USING (j, pos) WHERE f IS NOT NULL GROUP BY j, epoch) a
 JOIN (SELECT epoch, sum(k * p0) AS s FROM kd JOIN ty USING (pos) GROUP BY epoch) e USING (epoch) LEFT JOIN (SELECT yy.i, epoch, sum(k * p0 * yy.g) AS s FROM kd JOIN ty USING (pos) JOIN yy ON yy.x = ty.x WHERE yy.g > 0 GROUP BY yy.i, epoch) h ON h.i = a.i AND h.epoch = a.epoch)""")
def simple_intervals(s: SparkSession, d: str) -> DataFrame:
    """Simple scores with bootstrap intervals; all systems share each epoch's draw of the labelled instances."""
    _, P0, X, Y, L = _tables(s, d)
    return _rounded(est.simple_intervals(X, P0, Y, _truth(L), _EPOCHS, "si"), 7)


_JOINT_DRAWS = """,
sj AS (SELECT sm.i, sm.j, px.pos, sm.w, sm.p / sm.q * sm.f AS a, CASE WHEN sm.f > 0 AND sm.p > 0 THEN p0 / sm.q ELSE 0 END AS b, CASE WHEN sm.f > 0 THEN p0 / sm.q ELSE 0 END AS c FROM sm JOIN px ON px.j = sm.j AND px.x = sm.x JOIN p0 ON p0.x = sm.x),
pe AS (SELECT i, j, epoch, max(w) AS w, sum(k * a) / sum(k) AS a, sum(k * b) / sum(k) AS b, sum(k * c) / sum(k) AS c FROM sj JOIN md USING (j, pos) GROUP BY i, j, epoch),
te AS (SELECT epoch, sum(k * p0 * g) / sum(k * p0) AS theta FROM kd JOIN ty USING (pos) GROUP BY epoch),
dr AS (SELECT i, sum(w * a) AS p, theta * coalesce(sum(w * b) / nullif(sum(w * c), 0), 0) AS r FROM pe JOIN te USING (epoch) GROUP BY i, epoch, theta)"""
_JOINT_BODY = _BASE + f"(SELECT jp.i, p, theta * nu AS r FROM jp JOIN nu USING (i), th) b JOIN (SELECT i, {_CI} FROM dr GROUP BY i) c ON b.i = c.i"


@query(_JOINT_BODY, "k_relation", more=_EST + _W + ",\n" + ",\n".join((_JP, _NU, _TH)) + _redraw("jo") + _JOINT_DRAWS)
def joint_intervals(s: SparkSession, d: str) -> DataFrame:
    """Joint scores with bootstrap intervals, weights and proposals held fixed."""
    P, P0, X, Y, L = _tables(s, d)
    return _rounded(est.joint_intervals(P, P0, X, Y, _truth(L), _EPOCHS, "jo"), 7)


@query("SELECT i AS submission_id, 'entity_relation' AS score_type, * EXCLUDE (i) FROM (" + _JOINT_BODY + ")", "k_relation", more=_EST.replace("1.0::DOUBLE + max(e) % 3 AS p0", "1.0::DOUBLE AS p0") + _W + ",\n" + ",\n".join((_JP, _NU, _TH)) + _redraw("pu") + _JOINT_DRAWS)
def published_scores(s: SparkSession, d: str) -> DataFrame:
    """Rows to append to the scores of submissions: joint scores with intervals, every instance of weight 1."""
    P, P0, X, Y, L = _tables(s, d)
    one = P0.select("x", F.lit(1.0).alias("p0"))
    out = est.joint_intervals(P, one, X, Y, _truth(L), _EPOCHS, "pu")
    return _rounded(out.select(F.col("i").alias("submission_id"), F.lit("entity_relation").alias("score_type"), *[c for c in out.columns if c != "i"]), 7)
