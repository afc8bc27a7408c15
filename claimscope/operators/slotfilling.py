"""Scores of slot-filling runs: (run_id, entity, prov, slot_value, eq), eq 0 where the value is wrong.

Modes: `anydoc` keys a fill by (entity, value), `closed-world` by (entity, provenance, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.operators.distributions import positions, redrawn
from claimscope.operators.estimators import systems_of


def key_columns(mode: str) -> list[str]:
    if mode not in ("closed-world", "condensed", "anydoc", "condensed-anydoc"):
        raise ValueError(f"unknown mode {mode!r}")
    return ["entity", "slot_value"] if mode.endswith("anydoc") else ["entity", "prov", "slot_value"]


def project_gold(gold: DataFrame, mode: str) -> DataFrame:
    """The greatest class of each key."""
    return gold.groupBy(*key_columns(mode)).agg(F.max("eq").alias("eq"))


def project_output(outputs: DataFrame, gold: DataFrame, mode: str) -> DataFrame:
    """Distinct outputs of each run with their class; unassessed ones are wrong, or left out in condensed modes."""
    keys = key_columns(mode)
    out = outputs.select("run_id", *keys).distinct()
    j = out.join(project_gold(gold, mode), keys, "inner" if mode.startswith("condensed") else "left")
    return j.withColumn("eq", F.coalesce("eq", F.lit(0)))


def entity_scores(outputs: DataFrame, gold: DataFrame, mode: str) -> DataFrame:
    """(run_id, entity, s, c, t): outputs, distinct right classes hit, distinct right classes of the entity."""
    labelled = project_output(outputs, gold, mode)
    t = project_gold(gold, mode).groupBy("entity").agg(F.countDistinct(F.when(F.col("eq") > 0, F.col("eq"))).alias("t"))
    s = labelled.groupBy("run_id", "entity").agg(F.count(F.lit(1)).alias("s"), F.countDistinct(F.when(F.col("eq") > 0, F.col("eq"))).alias("c"))
    return s.join(t, "entity").select("run_id", "entity", "s", "c", "t")


def prf(s: Column, c: Column, t: Column) -> tuple[Column, Column, Column]:
    p, r = F.coalesce(F.try_divide(c, s), F.lit(0.0)), F.coalesce(F.try_divide(c, t), F.lit(0.0))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def micro(scores: DataFrame) -> DataFrame:
    tot = scores.groupBy("run_id").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("t").alias("t"))
    p, r, f = prf(F.col("s"), F.col("c"), F.col("t"))
    return tot.select("run_id", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def macro(scores: DataFrame) -> DataFrame:
    p, r, f = prf(F.col("s"), F.col("c"), F.col("t"))
    return scores.select("run_id", p.alias("p"), r.alias("r"), f.alias("f")).groupBy("run_id").agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"))


def score_matrix(scores: DataFrame) -> DataFrame:
    """(run_id, entity, f1) in long form."""
    return scores.select("run_id", "entity", prf(F.col("s"), F.col("c"), F.col("t"))[2].alias("f1"))


def variance_components(matrix: DataFrame) -> DataFrame:
    """One row: variance between systems, between topics, and of their interaction (population variances), that of all
    scores, and the shares phi of the systems in all and rho in what the topics leave."""
    s, t, g = matrix.groupBy("run_id").agg(F.avg("f1").alias("ms")), matrix.groupBy("entity").agg(F.avg("f1").alias("mt")), matrix.agg(F.avg("f1").alias("mg"), F.var_pop("f1").alias("v_total"))
    inter = matrix.join(s, "run_id").join(t, "entity").crossJoin(g).agg(F.var_pop(F.col("f1") - F.col("ms") - F.col("mt") + F.col("mg")).alias("v_interaction"))
    one = s.agg(F.var_pop("ms").alias("v_system")).crossJoin(t.agg(F.var_pop("mt").alias("v_topic"))).crossJoin(inter).crossJoin(g.select("v_total"))  # one row each
    phi, rho = F.try_divide(F.col("v_system"), F.col("v_system") + F.col("v_topic") + F.col("v_interaction")), F.try_divide(F.col("v_system"), F.col("v_system") + F.col("v_interaction"))
    return one.withColumns({"phi": phi, "rho": rho})


def standardised(matrix: DataFrame) -> DataFrame:
    """(run_id, z): mean over topics of the z-score within the topic; a deviation of 0 counts as 1."""
    st = matrix.groupBy("entity").agg(F.avg("f1").alias("m"), F.stddev_pop("f1").alias("sd"))
    z = (F.col("f1") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return matrix.join(st, "entity").groupBy("run_id").agg(F.avg(z).alias("z"))


def leave_out_pool(outputs: DataFrame, gold: DataFrame, mode: str, team: Column) -> DataFrame:
    """(team, n_gold): gold keys that stay in the pool without a team, that is keys some other team contributed.
    Counting contributors once replaces one pass per team."""
    keys = key_columns(mode)
    g = project_gold(gold, mode).filter("eq > 0").select(*keys)
    by = outputs.withColumn("team", team).select("team", *keys).distinct().join(g, keys)
    n = by.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    pool = n.agg(F.count(F.lit(1)).alias("all"))
    only = by.join(n.filter("n = 1"), keys).groupBy("team").agg(F.count(F.lit(1)).alias("own"))
    teams = by.select("team").distinct()
    return teams.join(only, "team", "left").crossJoin(F.broadcast(pool)).select("team", (F.col("all") - F.coalesce("own", F.lit(0))).alias("n_gold"))


def mention_scores(outputs: DataFrame, gold: DataFrame) -> DataFrame:
    """(run_id, prov, s, c, t): per document with right fills, what a run states, what of it is right, what is right."""
    keys = ["prov", "entity", "slot_value"]
    right = gold.filter("eq > 0").select(*keys).distinct().withColumn("right", F.lit(1))
    out = outputs.select("run_id", *keys).distinct().join(right, keys, "left")
    return out.groupBy("run_id", "prov").agg(F.count(F.lit(1)).alias("s"), F.count("right").alias("c")).join(right.groupBy("prov").agg(F.count(F.lit(1)).alias("t")), "prov").select("run_id", "prov", "s", "c", "t")


def complete(scores: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """scores with a row of zeros for each run and key of totals (key, t) it says nothing about; the number of runs is
    checked, and the result has these rows by definition."""
    runs = systems_of(scores, "run_id")
    kind = dict(scores.dtypes)["run_id"]
    every = totals.select(key, F.col("t").alias("_t"), F.explode(F.array(*map(F.lit, runs)).cast(f"array<{kind}>")).alias("run_id"))
    j = every.join(scores, ["run_id", key], "left")
    return j.select("run_id", key, F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("c", F.lit(0)).alias("c"), F.col("_t").alias("t"))


def report(scores: DataFrame, key: str) -> DataFrame:
    """(run_id, key, precision, recall, f1): of each key, and of all as the keys `micro` and `macro`."""
    p, r, f = prf(F.col("s"), F.col("c"), F.col("t"))
    each = scores.select("run_id", F.col(key).cast("string").alias("key"), p.alias("precision"), r.alias("recall"), f.alias("f1"))
    total = lambda df, name: df.select("run_id", F.lit(name).alias("key"), "precision", "recall", "f1")
    return each.unionByName(total(micro(scores), "micro")).unionByName(total(macro(scores), "macro"))


def matrix_report(matrix: DataFrame) -> DataFrame:
    """(run_id, line): the scores of each run in the order of the entities, to four places, with tabs."""
    cells = F.array_sort(F.collect_list(F.struct("entity", F.format_string("%.4f", "f1").alias("v"))))
    return matrix.groupBy("run_id").agg(F.array_join(F.transform(cells, lambda x: x.v), "\t").alias("line"))


def resampled(scores: DataFrame, key: str, epochs: int, seed: str, interval: float = 0.95) -> DataFrame:
    """(run_id, metric, mean, low, high): micro and macro scores over keys that are drawn anew in each epoch."""
    at = positions(scores, [key])
    drawn = scores.join(at.select(key, "position"), key).join(redrawn(at, [], epochs, seed), "position")
    p, r, f = prf(F.col("s"), F.col("c"), F.col("t"))
    k = lambda c: F.sum(F.col("k") * c)
    per = drawn.groupBy("run_id", "epoch").agg(*[k(F.col(c)).alias(c) for c in "sct"], *[(k(c) / F.sum("k")).alias(n) for c, n in ((p, "macro_p"), (r, "macro_r"), (f, "macro_f1"))])
    values = F.map_from_arrays(F.array(*map(F.lit, ("micro_p", "micro_r", "micro_f1", "macro_p", "macro_r", "macro_f1"))), F.array(p, r, f, "macro_p", "macro_r", "macro_f1"))
    return _spread(per.select("run_id", "epoch", F.explode(values).alias("metric", "v")), ["run_id", "metric"], interval)


def _spread(values: DataFrame, keys: list[str], interval: float) -> DataFrame:
    side = (1 - interval) / 2
    return values.groupBy(*keys).agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(side)).alias("low"), F.percentile("v", F.lit(1 - side)).alias("high"))


def standardised_resampled(matrix: DataFrame, epochs: int, seed: str, interval: float = 0.95) -> DataFrame:
    """(run_id, mean, low, high) of the standardised score over topics drawn anew: a topic's mean and deviation are over
    systems, so they don't change with the draw."""
    st = matrix.groupBy("entity").agg(F.avg("f1").alias("m"), F.stddev_pop("f1").alias("sd"))
    z = matrix.join(st, "entity").select("run_id", "entity", ((F.col("f1") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("z"))
    at = positions(z, ["entity"])
    per = z.join(at.select("entity", "position"), "entity").join(redrawn(at, [], epochs, seed), "position").groupBy("run_id", "epoch").agg((F.sum(F.col("k") * F.col("z")) / F.sum("k")).alias("v"))
    return _spread(per, ["run_id"], interval)


def left_out_scores(outputs: DataFrame, gold: DataFrame, mode: str, team: Column) -> DataFrame:
    """(run_id, entity, s, c, t): the scores of each run against the gold that other teams contribute to. A class is
    lost where the run's team alone states all its keys, an entity where it alone states all keys; so counting sole
    contributors once replaces one pass over the gold per run."""
    keys = key_columns(mode)
    g = project_gold(gold, mode)
    out = outputs.withColumn("team", team)
    by = out.select("team", *keys).distinct().join(g, keys)
    n = by.groupBy(*keys, "eq").agg(F.count(F.lit(1)).alias("n"), F.min("team").alias("sole"))
    n = g.join(n.drop("eq"), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lone = n.filter("n = 1")
    # what no team states is in no pool at all
    classes = n.filter("eq > 0 AND n > 0").groupBy("entity", "eq").agg(F.count(F.lit(1)).alias("size"))
    total = classes.groupBy("entity").agg(F.count(F.lit(1)).alias("t"))
    lost = lone.filter("eq > 0").groupBy("sole", "entity", "eq").agg(F.count(F.lit(1)).alias("own")).join(classes, ["entity", "eq"]).filter("own = size").groupBy("sole", "entity").agg(F.count(F.lit(1)).alias("lost"))
    whole = n.filter("n > 0").groupBy("entity").agg(F.count(F.lit(1)).alias("all"))
    gone = lone.groupBy("sole", "entity").agg(F.count(F.lit(1)).alias("own")).join(whole, "entity").filter("own = all").select("sole", "entity")
    labelled = out.select("run_id", "team", *keys).distinct().join(n.select(*keys, "eq", "n"), keys, "left").withColumn("eq", F.when(F.col("n") > 1, F.col("eq")).otherwise(0))
    s = labelled.groupBy("run_id", "team", "entity").agg(F.count(F.lit(1)).alias("s"), F.countDistinct(F.when(F.col("eq") > 0, F.col("eq"))).alias("c"))
    j = s.join(whole.select("entity"), "entity", "left_semi").join(total, "entity", "left").join(lost.withColumnRenamed("sole", "team"), ["team", "entity"], "left").join(gone.withColumnRenamed("sole", "team"), ["team", "entity"], "left_anti")
    return j.select("run_id", "entity", "s", "c", (F.coalesce("t", F.lit(0)) - F.coalesce("lost", F.lit(0))).alias("t"))


def bias_summary(full: DataFrame, pooled: DataFrame, tops: tuple[int, ...] = (40, 10, 3)) -> DataFrame:
    """(top, metric, mean, median) of the absolute differences between two tables of macro scores, over the best runs by
    the F1 of the first."""
    ranked = full.selectExpr("*", "row_number() OVER (ORDER BY f1 DESC, run_id) AS rank")  # one row per run
    o = pooled.select("run_id", *[F.col(c).alias(f"o_{c}") for c in ("precision", "recall", "f1")])
    gaps = ranked.join(o, "run_id").select("rank", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("precision", "recall", "f1"))), F.array(*[F.abs(F.col(c) - F.col(f"o_{c}")) for c in ("precision", "recall", "f1")]))).alias("metric", "gap"))
    each = gaps.withColumn("top", F.explode(F.array(*map(F.lit, tops)))).filter("rank <= top")
    return each.groupBy("top", "metric").agg(F.avg("gap").alias("mean"), F.median("gap").alias("median"))


def transformed(outputs: DataFrame, gold: DataFrame, mode: str = "closed-world") -> DataFrame:
    """(run_id, x, f, p): the runs as samplers. A right class that a run hits counts with all its keys, each with the
    inverse of their number; wrong outputs count 1; p is normalised within a run. x: the key as text."""
    keys = key_columns(mode)
    g = project_gold(gold, mode)
    x = F.concat_ws("|", *keys).alias("x")
    fills = g.filter("eq > 0").groupBy("entity", "eq").agg(F.count(F.lit(1)).alias("n"))
    labelled = outputs.select("run_id", *keys).distinct().join(g, keys, "left").withColumn("eq", F.coalesce("eq", F.lit(0)))
    wrong = labelled.filter("eq = 0").select("run_id", x, F.lit(0).alias("f"), F.lit(1.0).alias("p"))
    hit = labelled.filter("eq > 0").select("run_id", "entity", "eq").distinct()
    right = hit.join(g, ["entity", "eq"]).join(fills, ["entity", "eq"]).select("run_id", x, F.lit(1).alias("f"), (1.0 / F.col("n")).alias("p"))
    both = wrong.unionByName(right)
    total = both.groupBy("run_id").agg(F.sum("p").alias("_z"))
    return both.join(total, "run_id").select("run_id", "x", "f", (F.col("p") / F.col("_z")).alias("p"))


def pooled_simulation(samplers: DataFrame, weight: DataFrame, team: Column, epochs: int, seed: str, fraction: float = 0.5) -> DataFrame:
    """(run_id, n, precision, recall, and each estimate's mean, low and high): pools of a fraction of the teams, in the
    order of a hash, judge the runs of the others. Epochs are a key of the tables, not a loop. weight: (x, u)."""
    from claimscope.operators.distributions import uniform

    named = samplers.withColumn("team", team)
    teams = named.select("team").distinct()
    n_teams = len(systems_of(teams, "team"))
    order = teams.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("u", uniform(seed, F.col("epoch"), F.col("team")))
    pooled = order.selectExpr("epoch", "team", f"row_number() OVER (PARTITION BY epoch ORDER BY u, team) <= {int(n_teams * fraction)} AS pooled")
    known = named.filter("f = 1").select("x", "team").distinct().join(pooled.filter("pooled"), "team").select("epoch", "x").distinct().join(weight, "x")
    total = known.groupBy("epoch").agg(F.sum("u").alias("z"))
    rest = named.join(pooled.filter("NOT pooled"), "team").join(known, ["epoch", "x"], "left")
    per = rest.groupBy("epoch", "run_id").agg(F.sum(F.when(F.col("u").isNotNull(), F.col("p")).otherwise(0.0)).alias("p"), F.coalesce(F.sum("u"), F.lit(0.0)).alias("r")).join(total, "epoch").withColumn("r", F.try_divide("r", "z"))
    every = weight.agg(F.sum("u").alias("z"))
    true = named.join(weight, "x", "left").groupBy("run_id").agg(F.sum(F.col("p") * F.col("f")).alias("precision"), F.sum(F.when(F.col("f") == 1, F.col("u"))).alias("h")).crossJoin(every)  # one row on the right
    true = true.select("run_id", "precision", F.coalesce(F.try_divide("h", "z"), F.lit(0.0)).alias("recall"))
    cut = lambda c, q, n: F.percentile(c, F.lit(q)).alias(n)
    return true.join(per.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p_mean"), cut("p", 0.05, "p_low"), cut("p", 0.95, "p_high"), F.avg("r").alias("r_mean"), cut("r", 0.05, "r_low"), cut("r", 0.95, "r_high")), "run_id")


def quadratic_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (a, b, c): least squares of y = a x^2 + b x + c, by the normal equations of one aggregation; nulls where
    fewer than three places differ."""
    v, w = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.pow(v, F.lit(i))).alias(f"s{i}") for i in (1, 2, 3, 4)], *[F.sum(F.pow(v, F.lit(i)) * w).alias(f"t{i}") for i in (0, 1, 2)])
    rows = [["s4", "s3", "s2"], ["s3", "s2", "s1"], ["s2", "s1", "n"]]
    right = ["t2", "t1", "t0"]

    def det(m):
        c = [[F.col(v) for v in row] for row in m]
        return c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])

    swapped = lambda i: [[right[r] if k == i else v for k, v in enumerate(row)] for r, row in enumerate(rows)]
    return s.select(*[F.try_divide(det(swapped(i)), det(rows)).alias(n) for i, n in enumerate("abc")])
