"""Joins on spans. With an equi-key (the document) containment and overlap are residuals of a hash or merge join;
without one, or where a key holds very many spans, both sides are cut into bins, and a pair is kept in the first bin
that both share, so that no distinct is needed. Spans are half open; empty spans neither contain nor overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 256


def contains(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (a_lo <= b_lo) & (b_hi <= a_hi) & (b_lo < b_hi)


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (a_lo < b_hi) & (b_lo < a_hi) & (a_lo < a_hi) & (b_lo < b_hi)


def overlap_length(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.greatest(F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo), F.lit(0))


def contained_in(inner: DataFrame, outer: DataFrame, keys: list[str], i: tuple[str, str] = ("lo", "hi"), o: tuple[str, str] = ("o_lo", "o_hi"), how: str = "inner", width: int = BIN) -> DataFrame:
    """inner rows with each outer span of their key that contains them. The inner span lies in the bin of its
    beginning, the outer one is spread over its bins: equal keys with very many spans fall apart by bin."""
    a = inner.withColumn("_bin", F.floor(F.col(i[0]) / width))
    b = outer.filter(F.col(o[0]) < F.col(o[1])).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(o[0]) / width), F.floor((F.col(o[1]) - 1) / width))))
    cond = contains(F.col(o[0]), F.col(o[1]), F.col(i[0]), F.col(i[1]))
    return a.join(b, [*keys, "_bin"], how).filter(cond).drop("_bin")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str] = ("lo", "hi"), b: tuple[str, str] = ("o_lo", "o_hi"), width: int = BIN) -> DataFrame:
    """Pairs of overlapping spans of equal keys, each once."""
    spread = lambda df, x: df.filter(F.col(x[0]) < F.col(x[1])).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(x[0]) / width), F.floor((F.col(x[1]) - 1) / width))))
    cond = overlaps(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1])) & (F.col("_bin") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width))
    return spread(left, a).join(spread(right, b), [*keys, "_bin"]).filter(cond).drop("_bin")


def next_at_or_after(points: DataFrame, spans: DataFrame, keys: list[str], point: str, lo: str, columns: list[str]) -> DataFrame:
    """A forward as-of join: for each point the first span of its key that begins at or after it. Both sides are
    united and scanned once per key in descending order; the nearest span is carried along."""
    from pyspark.sql import Window

    value = F.struct(F.col(lo).alias("_lo"), *[F.col(c) for c in columns])
    kinds = {f.name: f.dataType for f in points.schema.fields}
    s = spans.select(*keys, F.col(lo).cast("long").alias("_at"), F.lit(1).alias("_side"), value.alias("_v"), *[F.lit(None).cast(kinds[c]).alias(f"_p_{c}") for c in points.columns])
    p = points.select(*keys, F.col(point).cast("long").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(s.schema["_v"].dataType).alias("_v"), *[F.col(c).alias(f"_p_{c}") for c in points.columns])
    # descending: at one position spans come before points; of equal spans the least comes last
    w = Window.partitionBy(*keys).orderBy(F.col("_at").desc(), F.col("_side").desc(), F.col("_v").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = p.unionByName(s).withColumn("_next", F.last("_v", ignorenulls=True).over(w)).filter("_side = 0")
    return out.select(*[F.col(f"_p_{c}").alias(c) for c in points.columns], F.col("_next._lo").alias(f"next_{lo}"), *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])
