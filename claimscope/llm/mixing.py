"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every text draws an exponential key -ln(u) / w from a hash-derived uniform u and its quality weight w; within a
source, texts in the order of their keys are a weighted sample without replacement. A source's budget is its share
of the mixture; complete epochs (every text once) come first, and the fraction that remains is the prefix of texts
whose running token sum stays within the budget.

Size of the mixture: by default the largest in which every source that has texts reaches its share within its
repeats (shares of sources without texts fall to the others in proportion); `total_tokens` sets another, and a
source that can't fill its share then gives all it may.

Scale: texts are measured where they are read; only fingerprint, size and weight are shuffled. Equal texts count as one
text (the least id stands for all, so no text exceeds its repeats under other ids): they are grouped by a 128-bit
fingerprint with a partial minimum before the shuffle. Keys are range-partitioned by (source, key), whose borders
Spark draws from the keys themselves, so a source with a third of all texts is spread evenly over tasks; prefix sums
run within (source, range) and over the small table of range totals.

Defined results: null and empty texts and null sources are in no mixture; sources without a target are left out;
targets without texts are reported with share 0; a null or negative share counts as 0, max_repeats below 1 as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.tokens import FOLDER, count_tokens
from claimscope.session import written

MAX_SOURCES = 10_000


def uniform(seed: str, *key: Column) -> Column:
    """A uniform in (0, 1] from 52 bits of an MD5: the same on any engine and partitioning."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key])), 1, 13), 16, 10).cast("double")
    return (bits + 1) / F.lit(4503599627370497.0)


def quality(text: Column) -> Column:
    """A quality weight in (0, 1]: the share of letters and spaces, less for very short texts and lost characters."""
    n = F.char_length(text)
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{M} ]", ""))
    lost = F.when(F.contains(text, F.lit("�")), 0.2).otherwise(1.0)
    return F.greatest(F.lit(0.05), F.try_divide(letters, n) * F.least(F.lit(1.0), n / 200.0) * lost)


def candidates(documents: DataFrame, targets: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(source, doc_id, n_tokens, weight): each distinct text of a source with a target."""
    wanted = targets.select("source").dropna().distinct()
    d = documents.select("doc_id", "text", "source").filter(F.col("text") != "").join(wanted, "source", "left_semi")
    measured = d.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), "doc_id", "source", count_tokens("text", folder).alias("n_tokens"), quality(F.col("text")).alias("weight"))
    first = measured.filter("n_tokens > 0").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "source", "n_tokens", "weight")).alias("x"))
    return first.select("x.source", "x.doc_id", "x.n_tokens", "x.weight")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: str = "mix", folder: str = FOLDER) -> tuple[DataFrame, DataFrame]:
    """(chosen: source, doc_id, n_tokens, repeats; shares: one row per target)."""
    keyed = candidates(documents, targets, folder).withColumn("k", -F.log(uniform(seed, F.col("doc_id"))) / F.col("weight"))
    keyed = written(keyed, "texts")
    # ranges depend on drawn borders, so they are written down before use
    texts = written(keyed.repartitionByRange("source", "k", "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    goal = targets.select("source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats")).dropna(subset=["source"]).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_texts"))
    rows = [r.asDict() for r in goal.join(have, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    live = [r for r in rows if r["available"] and r["target_share"] > 0 and r["max_repeats"] > 0]
    share = sum(r["target_share"] for r in live)
    most = min((r["available"] * r["max_repeats"] * share / r["target_share"] for r in live), default=0)
    total = most if total_tokens is None else total_tokens
    plan = []
    for r in rows:
        wanted = total * r["target_share"] / share if r in live else 0.0
        budget = int(min(wanted, (r["available"] or 0) * r["max_repeats"]))
        epochs = budget // r["available"] if r["available"] else 0
        plan.append((r["source"], int(epochs), int(budget - epochs * (r["available"] or 0)), float(r["target_share"]), int(r["max_repeats"]), int(r["available"] or 0)))
    spark = documents.sparkSession
    budgets = spark.createDataFrame(plan, "source string, epochs long, rest long, target_share double, max_repeats long, available long")

    ranges = texts.groupBy("source", "part").agg(F.sum("n_tokens").alias("t")).selectExpr("source", "part", "sum(t) OVER (PARTITION BY source ORDER BY part) - t AS before")
    # each source is one row of `budgets` (at most MAX_SOURCES), each (source, part) one of `ranges`
    running = texts.selectExpr("*", "sum(n_tokens) OVER (PARTITION BY source, part ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS inside")
    chosen = running.join(ranges, ["source", "part"]).join(budgets.select("source", "epochs", "rest"), "source")
    repeats = F.col("epochs") + F.when(F.col("before") + F.col("inside") <= F.col("rest"), 1).otherwise(0)
    chosen = chosen.select("source", "doc_id", "n_tokens", repeats.alias("repeats")).filter("repeats > 0")

    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("repeats").alias("most_repeats"))
    every = used.agg(F.sum("tokens").alias("all"))
    report = budgets.join(used, "source", "left").crossJoin(every)  # one row on the right
    shares = report.select("source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.try_divide(F.col("tokens").cast("double"), "all"), F.lit(0.0)).alias("actual_share"))
    return chosen, shares
