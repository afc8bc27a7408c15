"""The relational views: entity naming, alignment with gold, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.operators.ordering import distinct_on

ENTITY_TYPES = ("PER", "ORG", "GPE")


def entity_name(kind: Column, link: Column, gloss: Column) -> Column:
    """TITLE goes by its gloss, DATE by its link or date:gloss, the rest by link or gloss:gloss."""
    return F.when(kind == "TITLE", F.concat(F.lit("gloss:"), gloss)).when(kind == "DATE", F.coalesce(link, F.concat(F.lit("date:"), gloss))).otherwise(F.coalesce(link, F.concat(F.lit("gloss:"), gloss)))


def mention_link(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """Each mention with its canonical mention's name and entity; both joins keep the document's partitioning."""
    key = ["submission_id", "doc_id"]
    n = mentions.select(*key, F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), F.col("mention_type").alias("n_type"), F.col("gloss").alias("n_gloss"))
    k = links.select(*key, F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), "link_name")
    j = mentions.join(n, [*key, "c_lo", "c_hi"]).join(k, [*key, "c_lo", "c_hi"], "left")
    shown = F.when(F.col("n_type") == "DATE", F.concat(F.lit("date:"), F.col("n_gloss"))).otherwise(F.concat(F.lit("gloss:"), F.col("n_gloss")))
    return j.select(*key, "lo", "hi", "mention_type", "gloss", "c_lo", "c_hi", shown.alias("canonical_gloss"), entity_name(F.col("n_type"), F.col("link_name"), F.col("n_gloss")).alias("entity"))


def entity_relation(relations: DataFrame, mentions: DataFrame, links: DataFrame) -> DataFrame:
    """Relations with type and link of subject and object (null where a mention has no link)."""
    key = ["submission_id", "doc_id"]
    m = mentions.join(links, [*key, "lo", "hi"], "left")
    side = lambda p: m.select(*key, F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"), F.col("mention_type").alias(f"{p}_mention_type"), F.col("link_name").alias(f"{p}_link"))
    return relations.join(side("subject"), [*key, "subject_lo", "subject_hi"]).join(side("object"), [*key, "object_lo", "object_hi"])


def gold_mention_link(mentions: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions left-joined to links without those where `NOT (type = TITLE AND link is wiki)` isn't true: a TITLE
    without a link is dropped as well, as three-valued logic has it."""
    j = mentions.join(links, keys, "left")
    return j.filter(~((F.col("mention_type") == "TITLE") & F.col("link_name").startswith("wiki:")))


def entries_list(system: DataFrame, gold: DataFrame) -> DataFrame:
    """System relations aligned with gold on document and argument positions, with match flags (null where a side is)."""
    g = gold.select("doc_id", "subject_lo", "object_lo", F.col("relation").alias("gold_relation"), F.col("correct").alias("gold_correct"), F.col("g_subject_type"), F.col("g_subject_link"))
    j = system.join(g, ["doc_id", "subject_lo", "object_lo"])
    return j.withColumns({
        "type_match": F.col("subject_mention_type") == F.col("g_subject_type"),
        "entity_match": (F.col("subject_link") == F.col("g_subject_link")) | (F.col("subject_entity") == F.col("g_subject_link")),
        "relation_match": F.col("relation") == F.col("gold_relation"),
    })


def best_entries(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The best gold alignment of each system relation: matches first with nulls before true, then labels with nulls
    last; labels count only where types and entities match, and `correct` is their three-valued conjunction."""
    e = entries.withColumn("entity_correct", F.when(F.col("type_match") & F.col("entity_match"), F.col("gold_correct"))).withColumn("predicate_correct", F.when(F.col("type_match"), F.col("relation_match")))
    order = [F.col("type_match").desc_nulls_first(), F.col("entity_match").desc_nulls_first(), F.col("entity_correct").asc_nulls_last(), F.col("gold_relation").asc_nulls_last(), F.col("subject_link").asc_nulls_last(), F.col("object_link").asc_nulls_last(), F.col("relation").asc_nulls_last(), F.col("confidence").asc_nulls_last()]
    return distinct_on(e, keys, order).withColumn("correct", F.col("entity_correct") & F.col("predicate_correct"))


def statistics(relations: DataFrame) -> DataFrame:
    """Counts per (submission, subject, relation, object); objects of no entity type show as STRING but stay apart."""
    g = relations.groupBy("submission_id", "subject_entity", "relation", "object_entity").agg(F.count(F.lit(1)).alias("n"), F.min("object_type").alias("object_type"))
    return g.withColumn("object_entity", F.when(F.col("object_type").isin(*ENTITY_TYPES), F.col("object_entity")).otherwise("STRING")).drop("object_type")


def relation_counts(stats: DataFrame) -> DataFrame:
    return stats.groupBy("submission_id", "relation").agg(F.sum("n").alias("n"))


def entity_counts(stats: DataFrame) -> DataFrame:
    return stats.groupBy("submission_id", "subject_entity").agg(F.sum("n").alias("n"))


def entity_relation_counts(stats: DataFrame) -> DataFrame:
    return stats.groupBy("submission_id", "subject_entity").agg(F.countDistinct("object_entity").alias("n"))
