"""The llm queries: each takes (spark, folder of tables) and returns a DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.tables import load


def _consensus(spark: SparkSession, d: str):
    from claimscope.llm.consensus import Consensus, answers

    return Consensus(answers(load(spark, d, "evaluation_mention_response")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).items().filter("n_workers >= 3").select("doc_id", "span_lo", "span_hi", F.col("label").alias("mention_type"))


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    """Consensus, number of judges, pairwise agreement and margin of every judged span."""
    return _consensus(spark, d).items()


def p1_workers(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).workers()


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Krippendorff's alpha over all answers."""
    from claimscope.llm.consensus import answers, krippendorff

    a = krippendorff(answers(load(spark, d, "evaluation_mention_response")))
    return a.select("n_items", "n_answers", F.round("observed_disagreement", 6).alias("observed_disagreement"), F.round("expected_disagreement", 6).alias("expected_disagreement"), F.round("alpha", 6).alias("alpha"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from claimscope.llm.sentences import sentences

    return sentences(load(spark, d, "document")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from claimscope.llm.glyphs import same_reading, slices, vocabulary

    responses, documents = load(spark, d, "evaluation_mention_response"), load(spark, d, "document")
    vocab = vocabulary([documents.select("gloss"), responses.select("gloss")])
    return same_reading(slices(responses, documents), "gloss", "under", vocab).select("assignment_id", "doc_id", "span_lo", "span_hi").distinct()


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document text in its one form, with whether the stored text differs from it."""
    from claimscope.llm.glyphs import one_form, vocabulary

    documents = load(spark, d, "document").select("id", "gloss").dropna().distinct()
    vocab = vocabulary([documents.select("gloss"), load(spark, d, "evaluation_mention_response").select("gloss")])
    return one_form(documents, "gloss", vocab).select(F.col("id").alias("doc_id"), "form", (F.col("form") != F.col("gloss")).alias("changed"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from claimscope.llm.components import mention_groups

    return mention_groups(load(spark, d, "submission_mention"), load(spark, d, "submission_link"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    from claimscope.llm.tokens import count_tokens
    from claimscope.session import written

    return written(load(spark, d, "documents").select("doc_id", count_tokens("text").alias("n_tokens")), "sizes")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The contents of every container of every profile, with the space left unused."""
    from claimscope.llm.packing import pack

    return pack(_sizes(spark, d), load(spark, d, "pack_profile"))


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    from claimscope.llm.packing import packing_summary

    return packing_summary(p7_containers(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The chosen texts with their repeats."""
    from claimscope.llm.mixing import mixture

    return mixture(load(spark, d, "documents"), load(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    from claimscope.llm.mixing import mixture

    return mixture(load(spark, d, "documents"), load(spark, d, "mix_target"))[1]


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with their restored text (null where bytes were lost) and the chains that restore it."""
    from claimscope.llm.encoding import examine

    return examine(load(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_restored(spark, d).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_items, p1_workers, p1_agreement, p2_found, p5_found, p5_documents, p6_found, p7_containers, p7_summary, p8_mixture, p8_shares, p9_found, p9_restored)}
