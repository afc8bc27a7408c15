"""Stratified samples of relation instances with importance weights.

instances: kb, entity, relation, object, x (the instance within its fill), unique; every sum is within a kb. The weights
of a drawn instance turn the scheme's distribution into the uniform one over instances (mw), over entities, their
fills and the fills' instances (ew), and over relations and their instances (rw). Draws come from hashes of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.operators.distributions import uniform

KEY = ["kb", "entity", "relation", "object", "x"]


def sizes(instances: DataFrame) -> DataFrame:
    """instances with the counts that weights are made of: of their fill, of the entity's fills, of their relation, of all
    instances, entities and relations."""
    fill = instances.groupBy("kb", "entity", "relation", "object").agg(F.count(F.lit(1)).alias("n_fill"))
    entity = fill.groupBy("kb", "entity").agg(F.count(F.lit(1)).alias("n_fills"))
    relation = fill.groupBy("kb", "relation").agg(F.sum("n_fill").alias("n_relation"))
    entities = entity.groupBy("kb").agg(F.count(F.lit(1)).alias("n_entities"))
    every = relation.groupBy("kb").agg(F.sum("n_relation").alias("n_all"), F.count(F.lit(1)).alias("n_relations"))
    return instances.join(fill, ["kb", "entity", "relation", "object"]).join(entity, ["kb", "entity"]).join(relation, ["kb", "relation"]).join(entities, "kb").join(every, "kb")


def _weights(p: Column, one: str | None = None) -> list[Column]:
    mention, entity, relation = F.col("n_all"), F.col("n_entities") * F.col("n_fills") * F.col("n_fill"), F.col("n_relation") * F.col("n_relations")
    return [(F.lit(1.0) if name == one else p / q).alias(name) for name, q in (("mw", mention), ("ew", entity), ("rw", relation))]


def budgets(counts: DataFrame, n: int) -> DataFrame:
    """(kb, relation, per, taken): relations from the rarest up each get an equal share of what the rarer ones left.
    counts: kb, relation, n_relation, one row per relation, of which a kb has few."""
    rows = counts.groupBy("kb").agg(F.array_sort(F.collect_list(F.struct("n_relation", "relation"))).alias("r"))
    start = F.struct(F.lit(n).cast("long").alias("left"), F.size("r").cast("long").alias("open"), F.array().cast("array<struct<relation:string,per:bigint,taken:bigint>>").alias("out"))

    def share(acc: Column, r: Column) -> Column:
        per = F.floor(acc["left"] / acc["open"])
        taken = F.least(per, r["n_relation"])
        return F.struct((acc["left"] - taken).alias("left"), (acc["open"] - 1).alias("open"), F.concat(acc["out"], F.array(F.struct(r["relation"].alias("relation"), per.alias("per"), taken.alias("taken")))).alias("out"))

    return rows.select("kb", F.explode(F.aggregate("r", start, share, lambda acc: acc["out"])).alias("b")).select("kb", "b.*")


def by_relation(instances: DataFrame, n: int, seed: str) -> DataFrame:
    """n instances of each kb, relations as even as their counts allow: KEY, mw, ew, rw."""
    s = sizes(instances)
    b = budgets(s.select("kb", "relation", "n_relation").distinct(), n)
    drawn = s.join(b, ["kb", "relation"]).withColumn("_rn", F.row_number().over(Window.partitionBy("kb", "relation").orderBy(uniform(seed, *map(F.col, KEY)), *KEY))).filter("_rn <= taken")
    return drawn.select(*KEY, *_weights(F.col("n_relation") * F.lit(n) / F.least("n_relation", "per")))


def by_entity(instances: DataFrame, n: int, per_entity: int, seed: str) -> DataFrame:
    """Entities in the order of a hash, of each `per_entity` draws of a fill and of an instance of it, until n draws were
    made; an instance drawn again counts once: KEY, mw, ew, rw."""
    s = sizes(instances)
    entities = s.select("kb", "entity", "n_fills").distinct().withColumn("_u", uniform(seed, F.col("kb"), F.col("entity")))
    order = entities.withColumn("_e", F.row_number().over(Window.partitionBy("kb").orderBy("_u", "entity")))
    draws = order.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_entity)))).filter((F.col("_e") - 1) * per_entity + F.col("draw") <= n)
    pick = lambda name, size: F.least(F.floor(uniform(seed + name, F.col("kb"), F.col("entity"), F.col("draw")) * size), size - 1)
    fills = s.select("kb", "entity", "relation", "object").distinct().withColumn("_f", F.row_number().over(Window.partitionBy("kb", "entity").orderBy("relation", "object")) - 1)
    chosen = draws.withColumn("_f", pick("f", F.col("n_fills"))).select("kb", "entity", "draw", "_f").join(fills, ["kb", "entity", "_f"])
    placed = s.withColumn("_i", F.row_number().over(Window.partitionBy("kb", "entity", "relation", "object").orderBy("x")) - 1)
    j = chosen.join(placed, ["kb", "entity", "relation", "object"]).filter(F.col("_i") == pick("i", F.col("n_fill")))
    return j.select(*KEY, *_weights(F.col("n_entities") * F.col("n_fills") * F.col("n_fill"), "ew")).distinct()


def by_label(labelled: DataFrame, n: int, seed: str) -> DataFrame:
    """Half of n right and half wrong instances: KEY, correct, mw. labelled: KEY, correct; null labels are not drawn."""
    known = labelled.filter(F.col("correct").isNotNull())
    count = known.groupBy("kb").agg(F.count(F.lit(1)).alias("_r"), F.count_if("correct").alias("_t"))
    drawn = known.withColumn("_rn", F.row_number().over(Window.partitionBy("kb", "correct").orderBy(uniform(seed, *map(F.col, KEY)), *KEY))).filter(F.col("_rn") <= n // 2)
    return drawn.join(count, "kb").select(*KEY, "correct", (2 * F.when(F.col("correct"), F.col("_t")).otherwise(F.col("_r") - F.col("_t")) / F.col("_r")).alias("mw"))


def reweighted(sample: DataFrame, instances: DataFrame, scheme: str) -> DataFrame:
    """The weights of a sample drawn elsewhere (KEY), as if by entity or by relation: KEY, mw, ew, rw."""
    s = sizes(instances).join(sample.select(*KEY), KEY, "left_semi")
    if scheme == "entity":
        return s.select(*KEY, *_weights(F.col("n_entities") * F.col("n_fills") * F.col("n_fill"), "ew"))
    if scheme != "relation":
        raise ValueError(f"unknown scheme {scheme!r}")
    seen = s.groupBy("kb", "relation").agg(F.count(F.lit(1)).alias("_seen"))
    drawn = seen.groupBy("kb").agg(F.sum("_seen").alias("_n"))
    j = s.join(seen, ["kb", "relation"]).join(drawn, "kb")
    return j.select(*KEY, *_weights(F.col("n_relation") * F.col("_n") / F.col("_seen")))
