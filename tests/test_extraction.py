"""Facts from annotators' answers, by hand."""

import json

import pytest

from claimscope.operators import extraction as ex

SCHEMA = "assignment_id string, question_batch_id int, question_id string, doc_id string, batch_type string, response string, ignored boolean"


def arg(gloss, kind, span, canon=None, **entity):
    return {"gloss": gloss, "type": kind, "span": span, "entity": {"gloss": canon or gloss, "span": span, **entity}}


def answers(spark, *rows):
    return spark.createDataFrame([(a, 1, "q", "D", kind, r if r is None or isinstance(r, str) else json.dumps(r), ignored) for a, kind, r, ignored in rows], SCHEMA)


def links(df):
    return {(r.assignment_id, r.lo, r.link_name, r.correct) for r in ex.link_facts(df).collect()}


def test_selective_answers_of_the_new_payload(spark):
    one = {"version": 0.2, "relation": "per:sibling", "subject": arg(" Mukesh A ", "PER", ["10", "16"], link="wiki:Mukesh_A%27", canonicalCorrect=True, linkGold="Mukesh_B%27"), "object": arg("Singh", "PER", [1, 6], "Ram Singh", link="gloss:Singh", canonicalCorrect=True, linkGold=None)}
    two = {"version": 0.2, "relation": "no_relation", "subject": arg("clerk", "TITLE", [20, 25], link="wiki:X", canonicalCorrect=False, linkGold="Y"), "object": arg("Acme", "ORG", [30, 34], link="wiki:Acme", canonicalCorrect=False, linkGold="Acme")}
    df = answers(spark, ("a", "selective_relations", [one, two, two], None))
    assert {(r.lo, r.hi, r.mention_type, r.gloss, r.weight) for r in ex.mention_facts(df).collect()} == {(10, 16, "PER", "Mukesh A", 1.0), (1, 6, "PER", "Singh", 1.0), (20, 25, "TITLE", "clerk", 0.0), (30, 34, "ORG", "Acme", 0.0)}
    assert links(df) == {
        ("a", 10, "gloss:Mukesh A", True), ("a", 10, "wiki:Mukesh_A'", False), ("a", 10, "wiki:Mukesh_B'", True), ("a", 1, "gloss:Ram Singh", True), ("a", 1, "wiki:", True),
        ("a", 30, "gloss:Acme", False), ("a", 30, "wiki:Acme", True),
    }
    assert {(r.subject_lo, r.object_lo, r.relation) for r in ex.relation_facts(df).collect()} == {(10, 1, "per:siblings"), (20, 30, "no_relation")}


def test_selective_answers_of_the_old_payload(spark):
    old = {"relation": "per:title", "subject": {"gloss": "Al", "type": {"name": "PER"}, "doc_char_begin": 0, "doc_char_end": 2, "entity": {"gloss": "Al", "doc_char_begin": 0, "doc_char_end": 2, "link": "Al_%28x%29", "canonicalCorrect": "Yes", "linkCorrect": "No"}}, "object": {"gloss": "clerk", "type": {"name": "TITLE"}, "span": [5, 10], "entity": {"gloss": "clerk", "span": [5, 10], "link": "", "canonicalCorrect": "No"}}}
    df = answers(spark, ("a", "selective_relations", [old], False), ("b", "selective_relations", [old], True))
    assert {(r.assignment_id, r.lo, r.weight) for r in ex.mention_facts(df).collect()} == {("a", 0, 1.0), ("a", 5, 0.0)}
    assert links(df) == {("a", 0, "gloss:Al", True), ("a", 0, "wiki:Al_(x)", False), ("a", 5, "gloss:clerk", False)}


def test_exhaustive_answers(spark):
    rel = [{"relation": "per:title", "subject": arg("A", "PER", [3, 5]), "object": arg("b", "TITLE", [9, 7])}, {"relation": "org:unheard_of", "subject": arg("A", "PER", [3, 5]), "object": arg("b", "TITLE", [7, 9])}, {"relation": "per:title", "subject": arg("A", "PER", [3, 5]), "object": arg("b", "TITLE", [7, 9])}]
    ent = [arg("China", {"name": "GPE"}, [1, 6], link="China"), arg("Oslo", {"name": "GPE"}, [8, 12]), arg("May 15", {"name": "DATE"}, [20, 26], link="2001-05-15"), arg("clerk", {"name": "TITLE"}, [30, 35], link="x"), arg("bad", {"name": "PER"}, [5, 5], link="x")]
    df = answers(spark, ("r", "exhaustive_relations", rel, None), ("e", "exhaustive_entities", ent, None))
    assert {(r.subject_lo, r.object_lo, r.relation) for r in ex.relation_facts(df).collect()} == {(3, 7, "per:title")}
    assert {(r.lo, r.mention_type) for r in ex.mention_facts(df).collect()} == {(1, "GPE"), (8, "GPE"), (20, "DATE"), (30, "TITLE")}
    assert links(df) == {("e", 1, "wiki:China", True), ("e", 1, "gloss:China", True), ("e", 8, "wiki:", True), ("e", 8, "gloss:Oslo", True), ("e", 20, "date:2001-05-15", True)}


def test_unreadable_answers_give_nothing(spark):
    df = answers(spark, ("a", "selective_relations", None, None), ("b", "selective_relations", "", None), ("c", "selective_relations", "[{\"rel", None), ("d", "survey", [], None), ("e", None, [], None), ("f", "exhaustive_entities", "[]", None), ("g", "exhaustive_entities", [{}], None))
    for facts in (ex.mention_facts, ex.link_facts, ex.relation_facts):
        assert facts(df).count() == 0 and facts(df.limit(0)).count() == 0
    assert {(r.batch_type, r.n) for r in ex.unread(df).collect()} == {("survey", 1), (None, 1)}


def test_replacing_and_scopes(spark):
    f = spark.createDataFrame([("a", 1, "q", "D", 1), ("b", 1, "r", "D", 2), ("c", 2, "q", "E", 3)], "assignment_id string, question_batch_id int, question_id string, doc_id string, v int")
    new = f.filter("v < 3").selectExpr("assignment_id", "question_batch_id", "question_id", "doc_id", "v * 10 AS v")
    assert sorted(r.v for r in ex.replaced(f, new, f.filter("v = 1")).collect()) == [2, 3, 10]
    assert ex.in_scope(f, "questions", f.filter("v = 1")).count() == 2 and ex.in_scope(f, "batches", f.filter("v = 3")).count() == 1
    assert ex.in_scope(f, "all").count() == 3 and ex.in_scope(f, "documents", f.filter("doc_id = 'E'")).count() == 1
    with pytest.raises(ValueError):
        ex.in_scope(f, "hits")
