"""Precision and recall estimators over long tables.

P(i, x, p): distribution of system i over instances. P0(x, p0): weight of an instance. X(j, x, f): samples of system
j with label f, null where unlabelled. Y(i, x, g): exhaustively labelled instances, per system; a pair of a system and
an instance that Y lacks counts as 0, so that Y needs no row for what a system doesn't state. truth(x): the instances
that were labelled, by default those of Y. Sparse joins on x replace dense loops: only pairs of systems that share an
instance produce rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.operators.distributions import positions, redrawn, uniform

#: More systems than this aren't paired all with all; the heuristic weights need no such pairs.
MAX_SYSTEMS = 10_000


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def weighted(P: DataFrame, labels: DataFrame, P0: DataFrame, Y: DataFrame) -> DataFrame:
    """(i, precision, recall, f1): sum of p f, and the weight of true instances that the system states."""
    pr = P.join(labels.select("x", "f"), "x").groupBy("i").agg(F.coalesce(F.sum(F.col("p") * F.col("f")), F.lit(0.0)).alias("precision"))
    y = Y.filter("g > 0").select("x").distinct().join(P0, "x")
    total = y.agg(F.sum("p0").alias("z"))
    hit = P.filter("p > 0").select("i", "x").distinct().join(y, "x").groupBy("i").agg(F.sum("p0").alias("h"))
    out = pr.join(hit, "i", "left").crossJoin(F.broadcast(total))
    r = F.coalesce(F.try_divide("h", "z"), F.lit(0.0))
    return out.select("i", "precision", r.alias("recall"), f1(F.col("precision"), r).alias("f1"))


def simple(X: DataFrame, P0: DataFrame, Y: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(i, precision, recall, f1): mean label of the system's own samples; weighted share of the truth that it states.
    A pair with a null label counts neither above nor below."""
    pr = X.groupBy(F.col("j").alias("i")).agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias("precision"))
    every = (Y if truth is None else truth).select("x").distinct().join(P0, "x").agg(F.sum("p0").alias("_all"))
    hit = Y.join(P0, "x").groupBy("i").agg(F.sum(F.col("p0") * F.col("g")).alias("_hit"), F.sum(F.when(F.col("g").isNull(), F.col("p0"))).alias("_null"))
    j = pr.join(hit, "i", "left").crossJoin(every)  # one row on the right
    r = F.coalesce(F.try_divide(F.coalesce("_hit", F.lit(0.0)), F.col("_all") - F.coalesce("_null", F.lit(0.0))), F.lit(0.0))
    return j.select("i", "precision", r.alias("recall")).select("i", "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"))


def systems_of(df: DataFrame, column: str) -> list:
    """The distinct systems in order; refused beyond MAX_SYSTEMS."""
    found = [r[0] for r in df.select(column).distinct().orderBy(column).limit(MAX_SYSTEMS + 1).collect()]
    if len(found) > MAX_SYSTEMS:
        raise ValueError(f"more than {MAX_SYSTEMS} systems")
    return found


def weights(P: DataFrame, X: DataFrame, method: str = "heuristic") -> DataFrame:
    """(i, j, w, z): rows sum to one. heuristic: n_j * sum_x p_i p_j, uniform: 1, size: n_j; n_j counts labels."""
    n = X.groupBy("j").agg(F.count("f").alias("n"))
    if method == "heuristic":
        a, b = P.select("i", "x", F.col("p").alias("a")), P.select(F.col("i").alias("j"), "x", F.col("p").alias("b"))
        raw = a.join(b, "x").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s")).join(n, "j").select("i", "j", (F.col("s") * F.col("n")).alias("w"))
    elif method in ("uniform", "size"):
        ids = systems_of(P, "i")
        kind = dict(P.dtypes)["i"]
        pairs = n.withColumn("i", F.explode(F.array(*map(F.lit, ids)).cast(f"array<{kind}>")))  # the result itself has this size
        raw = pairs.select("i", "j", (F.lit(1.0) if method == "uniform" else F.col("n").cast("double")).alias("w"))
    else:
        raise ValueError(f"unknown weighting {method!r}")
    z = raw.groupBy("i").agg(F.sum("w").alias("z"))
    return raw.join(z, "i").filter("w > 0").select("i", "j", (F.col("w") / F.col("z")).alias("w"), "z")


def proposal(W: DataFrame, P: DataFrame) -> DataFrame:
    """(i, x, q): q_i(x) = sum_j w_ij p_j(x)."""
    return W.select("i", "j", "w").join(P.select(F.col("i").alias("j"), "x", "p"), "j").groupBy("i", "x").agg(F.sum(F.col("w") * F.col("p")).alias("q"))


def _sampled(P: DataFrame, X: DataFrame, W: DataFrame, Q: DataFrame) -> DataFrame:
    """(i, j, x, f, w, p, q) for each labelled sample of j under the proposal of i; p is 0 where i lacks x."""
    s = X.filter(F.col("f").isNotNull()).join(W.select("i", "j", "w"), "j").join(Q, ["i", "x"])
    return s.join(P, ["i", "x"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def joint_precision(P: DataFrame, X: DataFrame, W: DataFrame, Q: DataFrame) -> DataFrame:
    """(i, precision) = sum_j w_ij mean over samples of j of p_i / q_i f."""
    per = _sampled(P, X, W, Q).groupBy("i", "j").agg(F.avg(F.col("p") / F.col("q") * F.col("f")).alias("m"), F.max("w").alias("w"))
    return per.groupBy("i").agg(F.sum(F.col("w") * F.col("m")).alias("precision"))


def pooled_recall(P0: DataFrame, P: DataFrame, X: DataFrame, W: DataFrame, Q: DataFrame) -> DataFrame:
    """(i, nu): the part of what the pool found that system i found, self-normalised."""
    s = _sampled(P, X, W, Q).join(P0, "x")
    base = F.col("p0") / F.col("q") * F.when(F.col("f") > 0, 1.0).otherwise(0.0)
    per = s.groupBy("i", "j").agg(F.avg(base * F.when(F.col("p") > 0, 1.0).otherwise(0.0)).alias("nu"), F.avg(base).alias("z"), F.max("w").alias("w"))
    return per.groupBy("i").agg(F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("nu")), F.sum(F.col("w") * F.col("z"))), F.lit(0.0)).alias("nu"))


def merged_labels(Y: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(x, g): the greatest label of any system, null and missing ones as 0."""
    g = Y.groupBy("x").agg(F.max(F.coalesce("g", F.lit(0))).alias("g"))
    return g if truth is None else truth.select("x").distinct().join(g, "x", "left").select("x", F.coalesce("g", F.lit(0)).alias("g"))


def pool_recall(P0: DataFrame, Y: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """One row: theta, the weighted part of the truth that any system found."""
    return merged_labels(Y, truth).join(P0, "x").agg(F.coalesce(F.try_divide(F.sum(F.col("p0") * F.col("g")), F.sum("p0")), F.lit(0.0)).alias("theta"))


def joint(P: DataFrame, P0: DataFrame, X: DataFrame, Y: DataFrame, method: str = "heuristic", truth: DataFrame | None = None) -> DataFrame:
    """(i, precision, recall, f1) by importance sampling over all systems' samples."""
    W = weights(P, X, method)
    Q = proposal(W, P)
    out = joint_precision(P, X, W, Q).join(pooled_recall(P0, P, X, W, Q), "i").crossJoin(pool_recall(P0, Y, truth))  # one row on the right
    r = F.col("theta") * F.col("nu")
    return out.select("i", "precision", r.alias("recall"), f1(F.col("precision"), r).alias("f1"))


def updated_weights(W: DataFrame, P: DataFrame, X: DataFrame, new) -> DataFrame:
    """The heuristic weights (i, j, w, z) after system `new` came: old rows are brought back to their sums, only pairs
    with the new system are computed. Equal to `weights` over all systems."""
    n = X.groupBy("j").agg(F.count("f").alias("n"))
    mine = P.filter(F.col("i") == F.lit(new)).select("x", F.col("p").alias("b"))
    s = P.join(mine, "x").groupBy("i").agg(F.sum(F.col("p") * F.col("b")).alias("s"))
    row = s.join(n.select(F.col("j").alias("i"), "n"), "i").select(F.lit(new).alias("i"), F.col("i").alias("j"), (F.col("s") * F.col("n")).alias("w"))
    column = s.filter(F.col("i") != F.lit(new)).crossJoin(n.filter(F.col("j") == F.lit(new)).select("n")).select("i", F.lit(new).alias("j"), (F.col("s") * F.col("n")).alias("w"))  # one row on the right
    raw = W.select("i", "j", (F.col("w") * F.col("z")).alias("w")).unionByName(row).unionByName(column).filter("w > 0")
    z = raw.groupBy("i").agg(F.sum("w").alias("z"))
    return raw.join(z, "i").select("i", "j", (F.col("w") / F.col("z")).alias("w"), "z")


def updated_proposal(Q: DataFrame, W_old: DataFrame, W: DataFrame, P: DataFrame, new) -> DataFrame:
    """(i, x, q) after system `new` came: old proposals scaled by the ratio of their sums of weights, the new system's
    part added everywhere, and its own proposal from all systems. Equal to `proposal` over all systems."""
    scale = W_old.select("i", F.col("z").alias("_old")).distinct().join(W.select("i", "z").distinct(), "i").select("i", (F.col("_old") / F.col("z")).alias("_k"))
    old = Q.join(scale, "i").select("i", "x", (F.col("q") * F.col("_k")).alias("q"))
    fresh = W.filter((F.col("i") == F.lit(new)) | (F.col("j") == F.lit(new)))
    added = fresh.select("i", "j", "w").join(P.select(F.col("i").alias("j"), "x", "p"), "j").select("i", "x", (F.col("w") * F.col("p")).alias("q"))
    return old.unionByName(added).groupBy("i", "x").agg(F.sum("q").alias("q"))


def _placed(X: DataFrame) -> DataFrame:
    """X with the position of each sample among those of its system (a system has few samples) and their number."""
    own = Window.partitionBy("j")
    return X.withColumn("position", F.row_number().over(own.orderBy("x")) - 1).withColumn("total", F.count(F.lit(1)).over(own))


def _intervals(base: DataFrame, draws: DataFrame, interval: float) -> DataFrame:
    """(i, precision, recall, f1, and of each the low and high percentile over the epochs)."""
    side = (100.0 - interval) / 100
    cuts = [F.percentile(c, F.lit(at)).alias(f"{c}_{name}") for c in ("precision", "recall", "f1") for name, at in (("low", side), ("high", 1 - side))]
    return base.join(draws.withColumn("f1", f1(F.col("precision"), F.col("recall"))).groupBy("i").agg(*cuts), "i")


def simple_intervals(X: DataFrame, P0: DataFrame, Y: DataFrame, truth: DataFrame, epochs: int, seed: str, interval: float = 90.0) -> DataFrame:
    """`simple` with intervals of a bootstrap: each epoch draws every system's samples anew, and the labelled instances
    once for all systems. interval 90 gives the 10th and 90th percentiles."""
    placed = _placed(X)
    drawn = placed.join(redrawn(placed, ["j"], epochs, seed), ["j", "position"])
    pr = drawn.filter(F.col("f").isNotNull()).groupBy(F.col("j").alias("i"), "epoch").agg(F.try_divide(F.sum(F.col("k") * F.col("f")), F.sum("k")).alias("precision"))
    at = positions(truth, ["x"]).join(P0, "x")
    again = redrawn(at, [], epochs, f"{seed}Y").join(at.select("x", "position", "p0"), "position")
    every = again.groupBy("epoch").agg(F.sum(F.col("k") * F.col("p0")).alias("_all"))
    hit = again.join(Y.filter("g > 0").select("i", "x", "g"), "x").groupBy("i", "epoch").agg(F.sum(F.col("k") * F.col("p0") * F.col("g")).alias("_hit"))
    draws = pr.join(every, "epoch").join(hit, ["i", "epoch"], "left").select("i", "epoch", "precision", F.try_divide(F.coalesce("_hit", F.lit(0.0)), F.col("_all")).alias("recall"))
    return _intervals(simple(X, P0, Y, truth), draws, interval)


def joint_intervals(P: DataFrame, P0: DataFrame, X: DataFrame, Y: DataFrame, truth: DataFrame, epochs: int, seed: str, interval: float = 90.0) -> DataFrame:
    """`joint` with intervals of a bootstrap as in `simple_intervals`; weights and proposals stay those of the data."""
    W = weights(P, X)
    Q = proposal(W, P)
    placed = _placed(X)
    s = _sampled(P, placed, W, Q).join(P0, "x")
    true = F.when(F.col("f") > 0, 1.0).otherwise(0.0) * F.col("p0") / F.col("q")
    terms = s.select("i", "j", "position", "w", (F.col("p") / F.col("q") * F.col("f")).alias("a"), (true * F.when(F.col("p") > 0, 1.0).otherwise(0.0)).alias("b"), true.alias("c"))
    drawn = terms.join(redrawn(placed, ["j"], epochs, seed), ["j", "position"])
    mean = lambda c: F.sum(F.col("k") * F.col(c)) / F.sum("k")
    per = drawn.groupBy("i", "j", "epoch").agg(mean("a").alias("a"), mean("b").alias("b"), mean("c").alias("c"), F.max("w").alias("w"))
    pr = per.groupBy("i", "epoch").agg(F.sum(F.col("w") * F.col("a")).alias("precision"), F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("b")), F.sum(F.col("w") * F.col("c"))), F.lit(0.0)).alias("nu"))
    at = positions(truth, ["x"]).join(P0, "x").join(merged_labels(Y, truth), "x")
    theta = redrawn(at, [], epochs, f"{seed}Y").join(at.select("position", "p0", "g"), "position").groupBy("epoch").agg(F.try_divide(F.sum(F.col("k") * F.col("p0") * F.col("g")), F.sum(F.col("k") * F.col("p0"))).alias("theta"))
    draws = pr.join(theta, "epoch").select("i", "epoch", "precision", (F.col("theta") * F.col("nu")).alias("recall"))
    base = joint_precision(P, X, W, Q).join(pooled_recall(P0, P, X, W, Q), "i").crossJoin(pool_recall(P0, Y, truth))  # one row on the right
    r = F.col("theta") * F.col("nu")
    return _intervals(base.select("i", "precision", r.alias("recall"), f1(F.col("precision"), r).alias("f1")), draws, interval)


def variance(P: DataFrame, X: DataFrame, W: DataFrame, Q: DataFrame) -> DataFrame:
    """(i, variance) of the joint precision: sum_j w^2 / n_j * mean[(pf/q)^2 - pi_ij pf/q]; n_j counts all samples."""
    n = X.groupBy("j").agg(F.count(F.lit(1)).alias("n"))
    t = F.col("p") * F.col("f") / F.col("q")
    per = _sampled(P, X, W, Q).groupBy("i", "j").agg(F.avg(t * t).alias("s"), F.avg(t).alias("m"), F.max("w").alias("w")).join(n, "j")
    return per.groupBy("i").agg(F.sum(F.col("w") * F.col("w") / F.col("n") * (F.col("s") - F.col("m") * F.col("m"))).alias("variance"))


def bootstrap_precision(X: DataFrame, epochs: int, seed: str, interval: float = 90.0) -> DataFrame:
    """(j, precision, low, high): resampling as a weighted sum. A sample's multiplicity in an epoch is a Poisson(1)
    count from a hash, so that an epoch needs no shuffle of its own: one row per (system, epoch) leaves each task."""
    labelled = X.filter(F.col("f").isNotNull())
    e = labelled.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    u = uniform(seed, F.col("j"), F.col("x"), F.col("epoch"))
    # inverse of the Poisson(1) distribution function at u
    levels = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    k = sum((F.when(u > x, 1).otherwise(0) for x in levels), F.lit(0))
    per = e.withColumn("k", k).groupBy("j", "epoch").agg(F.try_divide(F.sum(F.col("k") * F.col("f")), F.sum("k")).alias("v"))
    side = (100.0 - interval) / 100
    ci = per.groupBy("j").agg(F.percentile("v", F.lit(side)).alias("low"), F.percentile("v", F.lit(1 - side)).alias("high"))
    return labelled.groupBy("j").agg(F.avg("f").alias("precision")).join(ci, "j")


def variance_by_size(P: DataFrame, X: DataFrame, most: int = 0, at: DataFrame | None = None) -> DataFrame:
    """(i, n, variance) for n of 1..most, or for those of at (i, n): bound of the variance of i's joint precision if i were the newest system, with
    n samples of its own yet to draw beside those that the others have. Weights and proposal are those of each n:
    sum_{j != i} w_j^2 / n_j (mean[(pf/q)^2] - mean[pf/q]^2) + w_i^2 / n sum_x p^3 / q^2, the last term for labels not
    known yet. Labels count in the weights, all samples in n_j, as in `weights` and `variance`."""
    count = X.groupBy("j").agg(F.count("f").alias("labels"), F.count(F.lit(1)).alias("n_j"))
    a, b = P.select("i", "x", F.col("p").alias("a")), P.select(F.col("i").alias("j"), "x", F.col("p").alias("b"))
    S = a.join(b, "x").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    raw = S.filter("i <> j").join(count.filter("labels > 0"), "j").select("i", "j", (F.col("s") * F.col("labels")).alias("r"), "labels", "n_j")
    z = raw.groupBy("i").agg(F.sum("r").alias("z"))
    systems = S.filter("i = j").select("i", F.col("s").alias("own")).join(z, "i", "left").select("i", "own", F.coalesce("z", F.lit(0.0)).alias("z"))  # one row per system
    mixed = raw.select("i", "j", "r").join(P.select(F.col("i").alias("j"), "x", "p"), "j").groupBy("i", "x").agg(F.sum(F.col("r") * F.col("p")).alias("mix"))
    base = P.filter("p > 0").join(mixed, ["i", "x"], "left").withColumn("mix", F.coalesce("mix", F.lit(0.0))).join(systems, "i")
    total = F.col("z") + F.col("n") * F.col("own")
    q = (F.col("mix") + F.col("n") * F.col("own") * F.col("p")) / total
    sizes = lambda df: df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most)))) if at is None else df.join(at.select("i", "n"), "i")
    own = sizes(base).groupBy("i", "n").agg(F.sum(F.col("p") * (F.col("p") / q) * (F.col("p") / q)).alias("e"), F.max(F.col("own") / total).alias("w"))
    own = own.select("i", "n", (F.col("w") * F.col("w") * F.col("n") * F.col("e")).alias("mine"))  # w_i = n own / total
    t = F.col("p") * F.col("f") / q
    drawn = sizes(X.filter("f <> 0").join(raw, "j").join(base, ["i", "x"]))  # others add nothing to the sums
    per = drawn.groupBy("i", "j", "n").agg(F.sum(t * t).alias("s2"), F.sum(t).alias("s1"), F.max(F.col("r") / total).alias("w"), F.max("labels").alias("labels"), F.max("n_j").alias("n_j"))
    m = F.col("s1") / F.col("labels")
    rest = per.groupBy("i", "n").agg(F.sum(F.col("w") * F.col("w") / F.col("n_j") * (F.col("s2") / F.col("labels") - m * m)).alias("rest"))
    return own.join(rest, ["i", "n"], "left").select("i", "n", (F.col("mine") + F.coalesce("rest", F.lit(0.0))).alias("variance"))


def conservative_variance(P: DataFrame, X: DataFrame) -> DataFrame:
    """(i, n, variance): the bound of `variance_by_size` at the number of samples that each system has."""
    return variance_by_size(P, X, at=X.groupBy(F.col("j").alias("i")).agg(F.count(F.lit(1)).cast("int").alias("n")))


def sample_sizes(by_size: DataFrame, target: int, eps: float = 5e-4) -> DataFrame:
    """(i, n): the samples out of 1..target that bring a system's variance within eps of 1 / target, what `target`
    samples of a system reach by themselves; `target` if fewer don't. by_size: (i, n, variance) for n of 1..target, of
    which a bisection looks at few; it ends at 2, as 1 is its lower bound."""
    v = by_size.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "variance"))), lambda x: x.variance).alias("v"))
    steps = F.sequence(F.lit(1), F.lit(max(target.bit_length(), 1)))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        got = F.get("v", mid - 1) - 1 / target
        narrowed = F.when(F.abs(got) <= eps, F.struct(mid.alias("low"), mid.alias("high"))).when(got < 0, F.struct(s["low"].alias("low"), mid.alias("high"))).otherwise(F.struct(mid.alias("low"), s["high"].alias("high")))
        return F.when(s["high"] - s["low"] > 1, narrowed).otherwise(s)

    found = F.aggregate(steps, F.struct(F.lit(1).alias("low"), F.lit(target).alias("high")), halve, lambda s: s["high"])
    return v.select("i", F.when(F.get("v", F.lit(target - 1)) >= 1 / target, F.lit(target)).otherwise(found).cast("int").alias("n"))
