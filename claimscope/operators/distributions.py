"""Sampling distributions over documents and relation instances, and draws from them.

Uniforms come from a hash of seed and key, so a draw is the same under any partitioning and on any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import written

INSTANCE = ["submission_id", "doc_id", "subject_lo", "subject_hi", "object_lo", "object_hi"]


def uniform(seed: str, *key: Column) -> Column:
    """A uniform in (0, 1]: 52 bits of the MD5 of seed and key, joined by '|'."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key])), 1, 13), 16, 10).cast("double")
    return (bits + 1) / F.lit(4503599627370497.0)


def normalised(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """p divided by its sum within keys, or over all rows; the sums are a small table of their own."""
    total = df.groupBy(*keys).agg(F.sum(p).alias("_z"))
    return (df.join(total, keys) if keys else df.crossJoin(total)).withColumn(p, F.try_divide(F.col(p), F.col("_z"))).drop("_z")


def document_uniform(documents: DataFrame, tag: str) -> DataFrame:
    """1/N for the distinct documents of each tag."""
    ids = documents.select(tag, "id").distinct()
    return ids.join(ids.groupBy(tag).agg(F.count(F.lit(1)).alias("_n")), tag).select(tag, "id", (1.0 / F.col("_n")).alias("p"))


def instance(relations: DataFrame) -> DataFrame:
    """1/N per submission."""
    n = relations.groupBy("submission_id").agg(F.count(F.lit(1)).alias("_n"))
    return relations.join(n, "submission_id").withColumn("p", 1.0 / F.col("_n")).drop("_n")


def relation(relations: DataFrame) -> DataFrame:
    """Every relation of a submission has the same mass, spread evenly over its instances."""
    n = relations.groupBy("submission_id", "relation").agg(F.count(F.lit(1)).alias("_n"))
    k = n.groupBy("submission_id").agg(F.count(F.lit(1)).alias("_k"))
    return relations.join(n.join(k, "submission_id"), ["submission_id", "relation"]).withColumn("p", 1.0 / F.col("_n") / F.col("_k")).drop("_n", "_k")


def entity(relations: DataFrame) -> DataFrame:
    """Every subject entity of a submission has the same mass."""
    n = relations.groupBy("submission_id", "subject_entity").agg(F.count(F.lit(1)).alias("_n"))
    k = n.groupBy("submission_id").agg(F.count(F.lit(1)).alias("_k"))
    return relations.join(n.join(k, "submission_id"), ["submission_id", "subject_entity"]).withColumn("p", 1.0 / F.col("_n") / F.col("_k")).drop("_n", "_k")


def entity_relation(relations: DataFrame, rc: DataFrame, ec: DataFrame, erc: DataFrame) -> DataFrame:
    """The distribution systems are sampled by: proportional to (distinct objects of the entity / relations of the
    entity) / relations of the kind, normalised per submission."""
    j = (
        relations.join(rc.withColumnRenamed("n", "_rc"), ["submission_id", "relation"])
        .join(ec.withColumnRenamed("n", "_ec"), ["submission_id", "subject_entity"])
        .join(erc.withColumnRenamed("n", "_erc"), ["submission_id", "subject_entity"])
    )
    raw = j.withColumn("p", F.col("_erc") / F.col("_ec") / F.col("_rc")).drop("_rc", "_ec", "_erc")
    return normalised(raw, ["submission_id"])


def draw_without_replacement(df: DataFrame, keys: list[str], ids: list[str], p: str, n: int, seed: str) -> DataFrame:
    """n rows of each key by exponential keys -ln(u)/p, the law of successive weighted draws; all where there are
    fewer. Rows of weight 0 or null are never drawn. A partial top-n per task comes before the shuffle."""
    keyed = df.filter(F.col(p) > 0).withColumn("_k", -F.log(uniform(seed, *[F.col(c) for c in ids])) / F.col(p))
    w = Window.partitionBy(*keys).orderBy("_k", *ids)
    return keyed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_k")


def draw_with_replacement(df: DataFrame, ids: list[str], p: str, n: int, seed: str, buckets: int = 256) -> DataFrame:
    """n independent draws: (ids..., draw). Cumulative sums run within hash buckets and over the small table of bucket
    totals; each uniform meets only the bucket it falls in."""
    b = df.filter(F.col(p) > 0).withColumn("_b", F.pmod(F.xxhash64(*ids), F.lit(buckets)))
    sums = b.groupBy("_b").agg(F.sum(p).alias("_t"))
    edges = sums.selectExpr("_b", "sum(_t) OVER (ORDER BY _b) - _t AS _from", "sum(_t) OVER () AS _all", "_t")  # at most `buckets` rows
    inside = b.selectExpr("*", f"sum({p}) OVER (PARTITION BY _b ORDER BY {', '.join(ids)} ROWS UNBOUNDED PRECEDING) AS _hi").withColumn("_lo", F.col("_hi") - F.col(p)).drop(p)
    u = df.sparkSession.range(1, n + 1).select(F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("_u"))
    at = u.join(F.broadcast(edges), (F.col("_u") * F.col("_all") > F.col("_from")) & (F.col("_u") * F.col("_all") <= F.col("_from") + F.col("_t"))).select("draw", "_b", (F.col("_u") * F.col("_all") - F.col("_from")).alias("_x"))
    return at.join(inside, (at["_b"] == inside["_b"]) & (F.col("_x") > F.col("_lo")) & (F.col("_x") <= F.col("_hi"))).select(*ids, "draw")


def positions(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., position, total): distinct ids with their place from 0 in their order. The ids of one distributed sort
    depend on where partitions begin, so they are written before use; offsets are one row per partition."""
    ranked = written(df.select(*ids).distinct().orderBy(*ids).withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_p", F.shiftright("_id", 33))
    parts = ranked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = parts.selectExpr("_p", "sum(_n) OVER (ORDER BY _p) - _n AS _off", "sum(_n) OVER () AS total")
    return ranked.join(offsets, "_p").select(*ids, (F.col("_off") + F.col("_id") - F.shiftleft(F.col("_p"), 33)).alias("position"), "total")


def draw_uniformly_with_replacement(df: DataFrame, ids: list[str], n: int, seed: str) -> DataFrame:
    """n draws, each floor(u * N) + 1 as the position in the order of ids."""
    placed = positions(df, ids)
    total = placed.agg(F.max("total").alias("total")).first()["total"] or 0
    u = df.sparkSession.range(1, n + 1).select(F.col("id").alias("draw"), F.least(F.floor(uniform(seed, F.col("id")) * F.lit(total)), F.lit(total) - 1).alias("position"))
    return u.join(placed, "position").select(*ids, "draw")


def redrawn(placed: DataFrame, by: list[str], epochs: int, seed: str) -> DataFrame:
    """(by..., epoch, position, k): how often each position comes up when each epoch draws as many as there are, with
    replacement. placed: by..., position, total; every place makes one draw per epoch from a hash of its own."""
    each = placed.select(*by, "position", "total").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    draw = F.least(F.floor(uniform(seed, *map(F.col, by), F.col("epoch"), F.col("position")) * F.col("total")), F.col("total") - 1)
    return each.select(*by, "epoch", draw.alias("position")).groupBy(*by, "epoch", "position").agg(F.count(F.lit(1)).alias("k"))


def kl_divergence(p: DataFrame, q: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """sum p ln(p/q), one row, or one for each value of the columns `by` of p; terms with p = 0 are 0; null where q
    lacks mass that p has."""
    by = by or []
    j = p.select(*by, *keys, F.col("p").alias("_p")).join(q.select(*keys, F.col("p").alias("_q")), keys, "left")
    term = F.when(F.col("_p") == 0, 0.0).otherwise(F.col("_p") * F.log(F.try_divide(F.col("_p"), F.col("_q"))))
    return j.groupBy(*by).agg(F.when(F.count_if(F.col("_p").isNotNull() & (F.col("_p") > 0) & F.coalesce(F.col("_q"), F.lit(0.0)).eqNullSafe(0.0)) == 0, F.sum(term)).alias("kl"))


def entropy(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """log of the total and entropy of the counts of each key."""
    z = counts.groupBy(*keys).agg(F.sum(n).alias("_z"), F.sum(F.col(n) * F.log(F.col(n))).alias("_s"))
    return z.select(*keys, F.log("_z").alias("log_z"), (F.log("_z") - F.col("_s") / F.col("_z")).alias("entropy"))
