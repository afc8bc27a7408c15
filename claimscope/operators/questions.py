"""Questions about sampled relation instances and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.scalars import question_id
from claimscope.operators.ordering import unordered


def relation_questions(samples: DataFrame, mentions: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, s_lo, s_hi, o_lo, o_hi, id, params): one question per unordered pair of a document that was not asked
    in either direction. An organisation beside a person, and a place beside anything else, become the object.
    samples: doc_id, s_lo, s_hi, o_lo, o_hi; mentions: doc_id, lo, hi, mention_type, gloss; asked: doc_id, s_lo, o_lo."""
    pairs = unordered(samples.distinct(), F.struct(F.col("s_lo").alias("lo"), F.col("s_hi").alias("hi")), F.struct(F.col("o_lo").alias("lo"), F.col("o_hi").alias("hi")), ["doc_id"], [F.col("s_lo"), F.col("s_hi"), F.col("o_lo"), F.col("o_hi")])
    both = asked.select("doc_id", "s_lo", "o_lo").unionByName(asked.select("doc_id", F.col("o_lo").alias("s_lo"), F.col("s_lo").alias("o_lo"))).distinct()
    fresh = pairs.join(both, ["doc_id", "s_lo", "o_lo"], "left_anti")
    one = mentions.groupBy("doc_id", "lo", "hi").agg(F.min(F.struct("mention_type", "gloss")).alias("m"))
    side = lambda x: one.select("doc_id", F.col("lo").alias(f"{x}_lo"), F.col("hi").alias(f"{x}_hi"), F.col("m.mention_type").alias(f"{x}_type"), F.regexp_replace("m.gloss", "^gloss:", "").alias(f"{x}_gloss"))
    j = fresh.join(side("s"), ["doc_id", "s_lo", "s_hi"]).join(side("o"), ["doc_id", "o_lo", "o_hi"])
    flip = ((F.col("s_type") == "ORG") & (F.col("o_type") == "PER")) | ((F.col("s_type") == "GPE") & (F.col("o_type") != "GPE") & F.col("o_type").isin("PER", "ORG"))
    pick = {f"{a}_{c}": F.when(flip, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")) for a, b in (("s", "o"), ("o", "s")) for c in ("lo", "hi", "type", "gloss")}
    q = j.select("doc_id", *[e.alias(k) for k, e in pick.items()])
    arg = lambda x: F.struct(F.col(f"{x}_gloss").alias("gloss"), F.array(f"{x}_lo", f"{x}_hi").alias("span"), F.col(f"{x}_type").alias("type"))
    params = F.to_json(F.struct(F.lit("selective_relations").alias("batch_type"), "doc_id", arg("o").alias("object"), arg("s").alias("subject")))
    parts = [F.format_string('"doc_id": "%s"', "doc_id"), F.format_string('"object": [%d, %d]', "o_lo", "o_hi"), F.format_string('"subject": [%d, %d]', "s_lo", "s_hi")]
    return q.select("doc_id", "s_lo", "s_hi", "o_lo", "o_hi", question_id(*parts).alias("id"), params.alias("params"))


def document_questions(sampled: DataFrame, asked: DataFrame) -> DataFrame:
    """Documents to annotate as a whole: sampled ones not asked about yet."""
    return sampled.select("doc_id").subtract(asked.select("doc_id"))
