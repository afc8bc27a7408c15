"""Queries of slot-filling reports, intervals, pooling bias and simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.operators import slotfilling as sf
from claimscope.plans.evaluation import _G
from claimscope.plans.sampling import _U
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


def _rounded(df: DataFrame, n: int = 8) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_PRF = "coalesce(c / nullif(s, 0), 0) AS p, coalesce(c / nullif(t, 0), 0) AS r"
_F = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
_MS = """rk AS (SELECT DISTINCT prov, entity, slot_value FROM k_run WHERE eq > 0), tt AS (SELECT prov, count(*) AS t FROM rk GROUP BY prov),
ms AS (SELECT run_id, prov, count(*) AS s, count(rk.prov2) AS c FROM (SELECT DISTINCT run_id, prov, entity, slot_value FROM k_run) o LEFT JOIN (SELECT prov, entity, slot_value, 1 AS prov2 FROM rk) rk USING (prov, entity, slot_value) SEMI JOIN tt USING (prov) GROUP BY run_id, prov),
dm AS (SELECT run_id, prov, coalesce(s, 0) AS s, coalesce(c, 0) AS c, t FROM (SELECT DISTINCT run_id FROM ms) CROSS JOIN tt LEFT JOIN ms USING (run_id, prov))"""


def _mention_scores(s: SparkSession, d: str) -> DataFrame:
    r = k.runs(s, d)
    m = sf.mention_scores(r, r)
    return sf.complete(m, r.filter("eq > 0").select("prov", "entity", "slot_value").distinct().groupBy("prov").agg(F.count(F.lit(1)).alias("t")), "prov")


@query("SELECT * FROM dm", "k_run", more=_MS)
def mention_scores(s: SparkSession, d: str) -> DataFrame:
    return _mention_scores(s, d)


def _report(table: str, key: str) -> str:
    return f"""SELECT run_id, key, round(p, 8) AS precision, round(r, 8) AS recall, round({_F}, 8) AS f1 FROM (
 SELECT run_id, CAST({key} AS VARCHAR) AS key, {_PRF} FROM {table} UNION ALL SELECT run_id, 'micro', {_PRF} FROM (SELECT run_id, sum(s) AS s, sum(c) AS c, sum(t) AS t FROM {table} GROUP BY run_id))
 UNION ALL SELECT run_id, 'macro', round(avg(p), 8), round(avg(r), 8), round(avg({_F}), 8) FROM (SELECT run_id, {_PRF} FROM {table}) GROUP BY run_id"""


@query(_report("dm", "prov"), "k_run", more=_MS)
def mention_report(s: SparkSession, d: str) -> DataFrame:
    return _rounded(sf.report(_mention_scores(s, d), "prov"))


def _entity_scores(s: SparkSession, d: str) -> DataFrame:
    r = k.runs(s, d)
    return sf.entity_scores(r, r, "anydoc")


@query(_report("sc", "entity"), "k_run", more=_G)
def entity_report(s: SparkSession, d: str) -> DataFrame:
    return _rounded(sf.report(_entity_scores(s, d), "entity"))


@query("SELECT run_id, string_agg(format('{:.4f}', f1::DOUBLE), chr(9) ORDER BY entity) AS line FROM mx GROUP BY run_id", "k_run", more=_G)
def score_matrix_report(s: SparkSession, d: str) -> DataFrame:
    return sf.matrix_report(sf.score_matrix(_entity_scores(s, d)))


_EPOCHS = 100


def _draw(keys: str, seed: str) -> str:
    u = _U.format(key=f"'{seed}|' || epoch || '|' || pos")
    return f"""ep AS (SELECT *, row_number() OVER (ORDER BY entity) - 1 AS pos, count(*) OVER () AS tot FROM (SELECT DISTINCT entity FROM {keys})),
dk AS (SELECT epoch, ep.entity, k FROM (SELECT epoch, CAST(least(floor({u} * tot), tot - 1) AS BIGINT) AS pos, count(*) AS k FROM ep, range(1, {_EPOCHS + 1}) t(epoch) GROUP BY ALL) JOIN ep USING (pos))"""


@query("SELECT run_id, metric, round(avg(v), 8) AS mean, round(quantile_cont(v, 0.025), 8) AS low, round(quantile_cont(v, 0.975), 8) AS high FROM (UNPIVOT dv ON micro_p, micro_r, micro_f1, macro_p, macro_r, macro_f1 INTO NAME metric VALUE v) GROUP BY ALL", "k_run", more=_G + ",\n" + _draw("sc", "iv") + f""",
pv AS (SELECT run_id, epoch, sum(k * s) AS s, sum(k * c) AS c, sum(k * t) AS t, sum(k * mx.p) / sum(k) AS macro_p, sum(k * mx.r) / sum(k) AS macro_r, sum(k * mx.f1) / sum(k) AS macro_f1 FROM sc JOIN mx USING (run_id, entity) JOIN dk USING (entity) GROUP BY run_id, epoch),
dv AS (SELECT run_id, epoch, p::DOUBLE AS micro_p, r::DOUBLE AS micro_r, ({_F})::DOUBLE AS micro_f1, macro_p::DOUBLE AS macro_p, macro_r::DOUBLE AS macro_r, macro_f1::DOUBLE AS macro_f1 FROM (SELECT *, {_PRF} FROM pv))""")
def score_intervals(s: SparkSession, d: str) -> DataFrame:
    """Micro and macro scores of each run over entities drawn anew: mean and 95 % interval."""
    return _rounded(sf.resampled(_entity_scores(s, d), "entity", _EPOCHS, "iv"))


@query("SELECT run_id, round(avg(v), 8) AS mean, round(quantile_cont(v, 0.025), 8) AS low, round(quantile_cont(v, 0.975), 8) AS high FROM (SELECT run_id, epoch, sum(k * z) / sum(k) AS v FROM zz JOIN dk USING (entity) GROUP BY run_id, epoch) GROUP BY run_id", "k_run", more=_G + ",\n" + _draw("mx", "sv")
       + ",\nzz AS (SELECT run_id, entity, (f1 - avg(f1) OVER w) / CASE WHEN stddev_pop(f1) OVER w = 0 THEN 1 ELSE stddev_pop(f1) OVER w END AS z FROM mx WINDOW w AS (PARTITION BY entity))")
def standardized_intervals(s: SparkSession, d: str) -> DataFrame:
    return _rounded(sf.standardised_resampled(sf.score_matrix(_entity_scores(s, d)), _EPOCHS, "sv"))


# pools: the gold a team leaves, key by key and run by run

_LEFT = """o AS (SELECT DISTINCT run_id, {team} AS team, entity, prov, slot_value FROM k_run), g AS (SELECT entity, prov, slot_value, max(eq) AS eq FROM k_run GROUP BY ALL),
rn AS (SELECT DISTINCT run_id, team FROM o), tk AS (SELECT DISTINCT team, entity, prov, slot_value FROM o),
pg AS (SELECT DISTINCT rn.run_id, g.* FROM rn JOIN tk ON tk.team <> rn.team JOIN g USING (entity, prov, slot_value)),
lt AS (SELECT run_id, entity, count(DISTINCT CASE WHEN eq > 0 THEN eq END) AS t FROM pg GROUP BY ALL),
ls AS (SELECT o.run_id, o.entity, count(*) AS s, count(DISTINCT CASE WHEN eq > 0 THEN eq END) AS c FROM o LEFT JOIN pg ON pg.run_id = o.run_id AND pg.entity = o.entity AND pg.prov = o.prov AND pg.slot_value = o.slot_value GROUP BY ALL),
lo AS (SELECT run_id, entity, s, c, t FROM ls JOIN lt USING (run_id, entity))"""


@query("SELECT * FROM lo", "k_run", more=_LEFT.format(team="run_id"))
def leave_run_out_scores(s: SparkSession, d: str) -> DataFrame:
    r = k.runs(s, d)
    return sf.left_out_scores(r, r, "closed-world", F.col("run_id"))


@query("SELECT * FROM lo", "k_run", more=_LEFT.format(team="run_id // 2"))
def leave_team_out_scores(s: SparkSession, d: str) -> DataFrame:
    r = k.runs(s, d)
    return sf.left_out_scores(r, r, "closed-world", F.expr("run_id div 2"))


_FULL = """fe AS (SELECT run_id, o.entity, count(*) AS s, count(DISTINCT CASE WHEN g.eq > 0 THEN g.eq END) AS c FROM o JOIN g USING (entity, prov, slot_value) GROUP BY ALL), ft AS (SELECT entity, count(DISTINCT CASE WHEN eq > 0 THEN eq END) AS t FROM g GROUP BY entity),
fm AS (SELECT run_id, avg(p) AS p, avg(r) AS r, avg({f}) AS f1 FROM (SELECT run_id, {prf} FROM fe JOIN ft USING (entity)) GROUP BY run_id), om AS (SELECT run_id, avg(p) AS p, avg(r) AS r, avg({f}) AS f1 FROM (SELECT run_id, {prf} FROM lo) GROUP BY run_id),
rk AS (SELECT fm.run_id, row_number() OVER (ORDER BY fm.f1 DESC, fm.run_id) AS rank, abs(fm.p - om.p)::DOUBLE AS precision, abs(fm.r - om.r)::DOUBLE AS recall, abs(fm.f1 - om.f1)::DOUBLE AS f1 FROM fm JOIN om USING (run_id))""".format(f=_F, prf=_PRF)


@query("SELECT CAST(top AS INT) AS top, metric, round(avg(gap), 8) AS mean, round(median(gap), 8) AS median FROM (UNPIVOT rk ON precision, recall, f1 INTO NAME metric VALUE gap), (VALUES (40), (10), (3)) v(top) WHERE rank <= top GROUP BY ALL", "k_run", more=_LEFT.format(team="run_id // 2") + ",\n" + _FULL)
def pooling_bias(s: SparkSession, d: str) -> DataFrame:
    """How far macro scores move when a team's own contributions leave the gold, over the best 40, 10 and 3 runs."""
    r = k.runs(s, d)
    full = sf.macro(sf.entity_scores(r, r, "closed-world"))
    return _rounded(sf.bias_summary(full, sf.macro(sf.left_out_scores(r, r, "closed-world", F.expr("run_id div 2")))))


_TRANSFORMED = """g AS (SELECT entity, slot_value, max(eq) AS eq FROM k_run GROUP BY ALL), fl AS (SELECT entity, eq, count(*) AS n FROM g WHERE eq > 0 GROUP BY ALL),
o AS (SELECT run_id, entity, slot_value, eq FROM (SELECT DISTINCT run_id, entity, slot_value FROM k_run) JOIN g USING (entity, slot_value)),
tr AS (SELECT run_id, entity || '|' || slot_value AS x, 0 AS f, 1.0::DOUBLE AS p FROM o WHERE eq = 0 UNION ALL SELECT run_id, entity || '|' || g.slot_value, 1, 1.0::DOUBLE / n FROM (SELECT DISTINCT run_id, entity, eq FROM o WHERE eq > 0) JOIN g USING (entity, eq) JOIN fl USING (entity, eq)),
tn AS (SELECT run_id, x, f, p / sum(p) OVER (PARTITION BY run_id) AS p FROM tr)"""


@query("SELECT run_id, x, CAST(f AS INT) AS f, round(p, 10) AS p FROM tn", "k_run", more=_TRANSFORMED)
def transformed_runs(s: SparkSession, d: str) -> DataFrame:
    r = k.runs(s, d)
    return _rounded(sf.transformed(r, r, "anydoc"), 10)


@query("SELECT run_id, count(*) AS n_true, count(*) FILTER (WHERE b.x IS NOT NULL) AS n_stated FROM (SELECT DISTINCT run_id FROM tn) CROSS JOIN (SELECT DISTINCT x FROM tn WHERE f = 1) a LEFT JOIN (SELECT run_id, x FROM tn) b USING (run_id, x) GROUP BY run_id", "k_run", more=_TRANSFORMED)
def projected_truth(s: SparkSession, d: str) -> DataFrame:
    """Of all right instances, how many each run states."""
    r = k.runs(s, d)
    t = sf.transformed(r, r, "anydoc")
    n = t.filter("f = 1").select("x").distinct().agg(F.count(F.lit(1)).alias("n_true"))
    return t.groupBy("run_id").agg(F.count_if(F.col("f") == 1).alias("n_stated")).crossJoin(n).select("run_id", "n_true", "n_stated")  # one row on the right


@query(f"""SELECT run_id, n, round(precision, 8) AS precision, round(recall, 8) AS recall, round(p_mean, 8) AS p_mean, round(p_low, 8) AS p_low, round(p_high, 8) AS p_high, round(r_mean, 8) AS r_mean, round(r_low, 8) AS r_low, round(r_high, 8) AS r_high FROM
 (SELECT run_id, sum(p * f) AS precision, sum(CASE WHEN f = 1 THEN u END) / (SELECT sum(u) FROM wu) AS recall FROM tn LEFT JOIN wu USING (x) GROUP BY run_id) JOIN
 (SELECT run_id, count(*) AS n, avg(p) AS p_mean, quantile_cont(p, 0.05) AS p_low, quantile_cont(p, 0.95) AS p_high, avg(r) AS r_mean, quantile_cont(r, 0.05) AS r_low, quantile_cont(r, 0.95) AS r_high FROM sm GROUP BY run_id) USING (run_id)""", "k_run", more=_TRANSFORMED + f""",
wu AS (SELECT entity || '|' || slot_value AS x, 1.0::DOUBLE / n AS u FROM g JOIN fl USING (entity, eq)),
tm AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY u, team) <= 2 AS pooled FROM (SELECT epoch, team, {_U.format(key="'po|' || epoch || '|' || team")} AS u FROM (SELECT DISTINCT run_id // 2 AS team FROM tn), range(1, 21) t(epoch))),
kn AS (SELECT DISTINCT epoch, x FROM tn JOIN tm ON tm.team = tn.run_id // 2 AND pooled WHERE f = 1), ks AS (SELECT epoch, sum(u) AS z FROM kn JOIN wu USING (x) GROUP BY epoch),
sm AS (SELECT epoch, run_id, sum(CASE WHEN kn.x IS NOT NULL THEN tn.p ELSE 0 END) AS p, coalesce(sum(CASE WHEN kn.x IS NOT NULL THEN wu.u END), 0) / max(z) AS r FROM tn JOIN tm ON tm.team = tn.run_id // 2 AND NOT pooled LEFT JOIN kn ON kn.epoch = tm.epoch AND kn.x = tn.x LEFT JOIN wu ON wu.x = tn.x JOIN ks ON ks.epoch = tm.epoch GROUP BY ALL)""".replace("SELECT epoch, run_id, sum(CASE", "SELECT tm.epoch, tn.run_id, sum(CASE"))
def pooled_simulation(s: SparkSession, d: str) -> DataFrame:
    """Estimates of runs by pools of half of the other teams, over 20 draws of the pool, beside their true scores."""
    r = k.runs(s, d)
    g = sf.project_gold(r, "anydoc").filter("eq > 0")
    u = g.join(g.groupBy("entity", "eq").agg(F.count(F.lit(1)).alias("n")), ["entity", "eq"]).select(F.concat_ws("|", "entity", "slot_value").alias("x"), (1.0 / F.col("n")).alias("u"))
    return _rounded(sf.pooled_simulation(sf.transformed(r, r, "anydoc"), u, F.expr("run_id div 2"), 20, "po"))


_D3 = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"


@query("SELECT round(" + _D3.format("t2", "s3", "s2", "t1", "s2", "s1", "t0", "s1", "n") + " / dd, 8) AS a, round(" + _D3.format("s4", "t2", "s2", "s3", "t1", "s1", "s2", "t0", "n") + " / dd, 8) AS b, round(" + _D3.format("s4", "s3", "t2", "s3", "s2", "t1", "s2", "s1", "t0") + " / dd, 8) AS c FROM (SELECT *, "
       + _D3.format("s4", "s3", "s2", "s3", "s2", "s1", "s2", "s1", "n") + """ AS dd FROM (SELECT count(*)::DOUBLE AS n, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM
 (SELECT position::DOUBLE AS x, avg(total) / 500 AS y FROM (SELECT run_id, position, sum(s) OVER (PARTITION BY run_id ORDER BY position) AS total FROM (SELECT run_id, entity AS position, s FROM sc)) GROUP BY position)))""", "k_run", more=_G)
def mean_trajectory_fit(s: SparkSession, d: str) -> DataFrame:
    """Quadratic trend of the mean running total over runs (here: outputs, entity by entity), in units of 500."""
    total = _entity_scores(s, d).selectExpr("run_id", "entity AS position", "sum(s) OVER (PARTITION BY run_id ORDER BY entity) AS total")
    mean = total.groupBy("position").agg((F.avg("total") / 500).alias("y"))
    return _rounded(sf.quadratic_fit(mean, "position", "y"))
