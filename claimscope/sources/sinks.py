"""Writers: statement files, exports, snapshots, idempotent replacement and upserts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.scalars import show_provenance


def statement_lines(mentions: DataFrame, links: DataFrame, canonical: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, key, value): the lines of a statement file; types, links, canonical mentions and relations in this order."""
    p = lambda c: show_provenance(F.col(f"{c}.doc_id"), F.col(f"{c}.lo"), F.col(f"{c}.hi"))
    line = lambda part, df, *cells: df.select(F.lit(part).alias("part"), F.concat_ws("\t", *cells).alias("value"))
    provs = F.array_join(F.transform("provenances", lambda x: show_provenance(x.doc_id, x.lo, x.hi)), ",")
    w = F.col("weight").cast("string")
    return (
        line(0, mentions, p("subject"), F.col("relation"), F.col("object"), F.lit(""), w)
        .unionByName(line(1, links, p("subject"), F.lit("link"), F.col("object"), F.lit(""), w))
        .unionByName(line(2, canonical, p("subject"), F.lit("canonical_mention"), p("object_prov"), F.lit(""), w))
        .unionByName(line(3, relations, p("subject"), F.col("relation"), p("object_prov"), provs, w))
    )


def write_statements(lines: DataFrame, path: str) -> None:
    """One ordered text file set: partitions in the order of the parts."""
    lines.orderBy("part", "value").select("value").write.mode("overwrite").text(path)


def export(df: DataFrame, path: str, order: list[str]) -> None:
    """Tab-separated files with a header, in order."""
    df.orderBy(*order).write.mode("overwrite").csv(path, sep="\t", header=True)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Write df so that it replaces exactly the partitions of the keys it holds: repeating an upload changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], update: list[str], fixed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): new rows are added, known ones take the `update` columns; where a `fixed` column would
    change, the row is a conflict and stays as it was. Both inputs have unique keys."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in [*update, *fixed]], F.lit(True).alias("_new"))
    j = stored.withColumn("_old", F.lit(True)).join(n, keys, "full_outer")
    clash = F.lit(False)
    for c in fixed:
        clash = clash | (F.col("_old") & F.col("_new") & ~F.col(c).eqNullSafe(F.col(f"_n_{c}")))
    clash = F.coalesce(clash, F.lit(False))
    take = lambda c: F.when(F.col("_new") & ~clash & (F.lit(c in update) | F.col("_old").isNull()), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    merged = j.select(*keys, *[take(c) for c in [*update, *fixed]])
    return merged, j.filter(clash).select(*keys, *[F.col(f"_n_{c}").alias(c) for c in fixed])


def insert_missing(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the new rows whose key it lacks, one row per new key."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))
