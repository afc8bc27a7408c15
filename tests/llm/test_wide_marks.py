"""Digits right after an end mark."""

import pytest
from pyspark.sql import functions as F

LARGER = "/root/testdata/sf0.1"  # the texts of sf0.001 are too few to learn this from: there the sentences stay joined
sentences = pytest.importorskip("claimscope.llm.sentences")


@pytest.mark.parametrize("text,refused", [("それだ。2019年", False), ("「それだ。」2019年", False), ("真的！3人", False), ("値は3．5だ", True), ("is 3.5 m", True), ("v.2", True)])
def test_digit_after_mark(text, refused):
    nxt = next(i for i, c in enumerate(text) if c.isdigit() and i and text[i - 1] in ".。！．」")
    assert sentences._refuses(text, nxt, nxt, len(text)) is refused


def test_sentence_may_begin_with_a_digit_after_a_wide_mark(spark):
    texts = spark.read.parquet(f"{LARGER}/document.parquet").select("id", "gloss").filter(F.col("gloss").isNotNull()).distinct()
    text = "昨日彼は銀行を訪れた。2019年に彼は会社を設立した。"
    own = spark.createDataFrame([("new", text)], "id string, gloss string")
    rows = sentences.sentences(texts.union(own)).filter("doc_id = 'new'").collect()
    assert sorted(text[r.span_lo : r.span_hi] for r in rows) == ["2019年に彼は会社を設立した。", "昨日彼は銀行を訪れた。"]
