"""Queries over every script and every shape of payload: brute force on small tables."""

import datetime as dt
import json
import re
import unicodedata

from pyspark.sql import functions as F

from claimscope.operators import estimators as est
from claimscope.operators import nested
from claimscope.plans import evaluation as ev
from claimscope.plans import general
from claimscope.plans import relational as rel
from claimscope.plans import sampling
from claimscope.sources.derived import sql
from tests.oracle import SMALL, connection

T = dt.datetime(2016, 5, 1)


def tables(spark, folder, **rows):
    """The folder, with a parquet table of each name from (schema, rows)."""
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


NAMES = [("Joño Vark", "wiki:Joño_Varka_(1)"), ("Мара Кель", "wiki:Мира_Кельм"), ("マガ銀行", "wiki:マガ行_(x)"), ("द्रुस्क", "wiki:द्रुक"), ("Ann Lee", "wiki:Lee"), ("plain", "wiki:Plane"), ("", "wiki:A"), (None, "wiki:B"), ("x", "")]


def test_token_levenshtein_has_every_script(spark, tmp_path):
    span = "struct<lo:int,hi:int>"
    m = (f"submission_id int, doc_id string, span {span}, updated timestamp, canonical_span {span}, mention_type string, gloss string", [(1, "d", (i, i + 1), T, (i, i + 1), "PER", g) for i, (g, _) in enumerate(NAMES)])
    li = (f"submission_id int, doc_id string, span {span}, updated timestamp, link_name string, confidence float", [(1, "d", (i, i + 1), T, n, 1.0) for i, (_, n) in enumerate(NAMES)])
    got = {r.lo: r.distance for r in rel.token_levenshtein(spark, tables(spark, tmp_path, submission_mention=m, submission_link=li)).collect()}
    assert got == {i: min(distance(a, b) for a in g.lower().split() for b in n[5:].lower().split("_")) for i, (g, n) in enumerate(NAMES) if g and n}


def test_token_levenshtein_of_all_mentions(spark):
    con = connection()
    con.create_function("words", lambda a, b: min(distance(x, y) for x in re.split(r"\s", a.lower()) for y in b.lower().replace("wiki:", "").split("_")), ["VARCHAR", "VARCHAR"], "BIGINT")
    want = con.execute(sql("SELECT submission_id, doc_id, lo, hi, words(m.gloss, l.link_name) FROM m JOIN l USING (submission_id, doc_id, lo, hi) WHERE m.gloss <> '' AND l.link_name <> ''", "m", "l")).fetchall()
    assert {tuple(r) for r in rel.token_levenshtein(spark, SMALL).select("submission_id", "doc_id", "lo", "hi", "distance").collect()} == set(want)


def unspaced(c):
    return any(x in unicodedata.name(c, "") for x in ("CJK UNIFIED", "HIRAGANA", "KATAKANA", "THAI")) and unicodedata.category(c)[0] in "LMN"


def runs(text):
    """(runs of words set apart by spaces or marks, runs of scripts without spaces)."""
    kinds = "".join("u" if unspaced(c) else "w" if unicodedata.category(c)[0] in "LMN" else " " for c in text)
    return [{text[m.start():m.end()] for m in re.finditer(f"{k}+", kinds)} for k in "wu"]


def matches(entities, texts):
    out = set()
    for e in entities:
        words, inside = runs(re.sub(r"^wiki:|_\([^)]*\)$", "", e).lower())
        out |= {(e, i) for i, t in texts.items() if words <= runs(t.lower())[0] and all(x in t.lower() for x in inside)} if words or inside else set()
    return out


def documents(spark, folder, texts, entities):
    pad = [*entities, *[None] * len(texts)]
    return tables(spark, folder, documents=("doc_id long, text string, kb_entity string", [(i, t, pad[i]) for i, t in texts.items()]))


def test_text_match_has_every_script(spark, tmp_path):
    entities = ["wiki:Joño_Vark_(1)", "wiki:Макитинбор_(5z)", "wiki:マガ銀行_(x)", "wiki:ナキダ・ケル", "wiki:玉", "wiki:तोररुन_(6)", "wiki:القابضة", "wiki:ธนาคาร_(7)", "wiki:No._4_Mill", "wiki:東京ABC"]
    texts = dict(enumerate(["JOÑO, of the Vark.", "Jo o Vark", "В Макитинбор вошли", "昨日マガ銀行は", "銀行とガ銀、マガ", "ケルのナキダは", "铎朔玉·岚", "玉米", "द्रुस्क तोररुन।", "نان القابضة", "ที่ธนาคารมาน", "ธนา คาร", "Mill No. 4", "Mill 44 no", "東京のABC", None, "ABCD 東京", ""]))
    folder = documents(spark, tmp_path, texts, entities)
    got = {tuple(r) for r in rel.text_match(spark, folder).collect()}
    want = matches(entities, {i: t for i, t in texts.items() if t})
    assert got == want and {e for e, _ in want} == set(entities)
    n = {i: sum(1 for _, x in want if x == i) for _, i in want}
    assert {r.doc_id: r.p for r in sampling.document_entity(spark, folder).collect()} == {i: round(x / len(want), 9) for i, x in n.items()}


def test_text_match_equals_brute_force(spark):
    rows = connection().execute("SELECT doc_id, text, kb_entity FROM documents").fetchall()
    got = [tuple(r) for r in rel.text_match(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == matches({e for _, _, e in rows if e}, {i: t for i, t, _ in rows if t is not None})


def questions(spark, folder):
    new = lambda a, b: {"batch_type": "selective_relations", "doc_id": "d", "subject": {"gloss": "A", "type": "PER", "span": [a, a + 2], "entity": {"link": "wiki:A"}}, "object": {"gloss": "B", "type": {"name": "ORG"}, "span": [b, b + 2]}}
    old = lambda a, b: {"batch_type": "selective_relations", "doc_id": "d", "mention_1": ["d", str(a), str(a + 2)], "mention_2": ["d", str(b), str(b + 2)]}
    every = {"batch_type": "exhaustive_entities", "doc_id": "d", "mentions": [{"gloss": "A", "type": {"name": "PER"}, "doc_char_begin": 0, "doc_char_end": 3, "entity": {"link": "wiki:A"}}]}
    texts = [new(1, 10), json.dumps(new(2, 20)), json.dumps(json.dumps(new(3, 30))), old(4, 40), json.dumps(old(5, 50)), every, json.dumps(every), 7, "words"]
    rows = [(1, str(i), T, "done", "", json.dumps(x)) for i, x in enumerate(texts)] + [(1, "cut", T, "done", "", json.dumps(new(1, 10))[:-4]), (1, "none", T, "done", "", None)]
    span = "struct<lo:int,hi:int>"
    pairs = [(a, 10 * a) for a in range(1, 7)] + [(10 * a, a) for a in range(1, 7)]
    samples = [(1, 1, "d", (a, a + 2), (b, b + 2), T) for a, b in pairs]
    return tables(spark, folder, evaluation_question=("batch_id int, id string, created timestamp, state string, message string, params string", rows),
                  submission_sample=(f"batch_id int, submission_id int, doc_id string, subject {span}, object {span}, created timestamp", samples))


def test_questions_count_in_every_shape(spark, tmp_path):
    folder = questions(spark, tmp_path)
    assert {(r.s_lo, r.b_lo) for r in rel.unasked_samples(spark, folder).collect()} == {(6, 60), (60, 6)}
    got = {(r.id, r.role): (r.lo, r.hi, r.gloss, r.mention_type, r.link) for r in ev.question_arguments(spark, folder).collect()}
    want = {(str(i), "subject"): (i + 1, i + 3, *(("A", "PER", "wiki:A") if i < 3 else [None] * 3)) for i in range(5)}
    want |= {(str(i), "object"): (10 * i + 10, 10 * i + 12, *(("B", "ORG", None) if i < 3 else [None] * 3)) for i in range(5)}
    assert got == want
    assert sorted(tuple(r) for r in ev.exhaustive_mentions(spark, folder).collect()) == [(1, x, 0, 3, "A", "PER", "wiki:A") for x in "56"]
    assert {(r.id, r.doc_id, r.subject_lo, r.legacy) for r in rel.json_question(spark, folder).collect()} == {*((str(i), "d", i + 1, None) for i in range(3)), *((str(i), "d", None, str(i + 1)) for i in (3, 4)), *((x, "d", None, None) for x in "56")}


def variance_of_newest(P, X, i, n):
    """By the formulas, with dictionaries: P[j][x], X[j] = [(x, f or None)]."""
    others = [j for j in P if j != i and any(f is not None for _, f in X[j])]
    raw = {j: sum(f is not None for _, f in X[j]) * sum(p * P[j].get(x, 0) for x, p in P[i].items()) for j in others} | {i: n * sum(p * p for p in P[i].values())}
    w = {j: r / sum(raw.values()) for j, r in raw.items()}
    q = lambda x: sum(w[j] * P[j].get(x, 0) for j in w)
    out = w[i] ** 2 / n * sum(p * (p / q(x)) ** 2 for x, p in P[i].items())
    for j in others:
        if w[j]:
            t = [P[i].get(x, 0) * f / q(x) for x, f in X[j] if f is not None]
            m = sum(t) / len(t)
            out += w[j] ** 2 / len(X[j]) * (sum(v * v for v in t) / len(t) - m * m)
    return out


def test_sample_sizes_follow_the_joint_variance(spark):
    P = {1: {"a": 0.5, "b": 0.25, "c": 0.25}, 2: {"a": 0.5, "b": 0.25, "c": 0.25}, 3: {"a": 0.1, "c": 0.2, "d": 0.7}, 4: {"z": 1.0}}
    X = {1: [("a", 1), ("b", 0), ("c", None)] * 60, 2: [("a", 1), ("b", 1), ("c", 0)] * 50, 3: [("d", 1), ("c", 0), ("a", 1)] * 5, 4: [("z", None)] * 3}
    p = spark.createDataFrame([(i, x, v) for i, d in P.items() for x, v in d.items()], "i long, x string, p double")
    x = spark.createDataFrame([(j, *r) for j, rows in X.items() for r in rows], "j long, x string, f int")
    got = {(r.i, r.n): r.variance for r in est.variance_by_size(p, x, 40).collect()}
    assert set(got) == {(i, n) for i in P for n in range(1, 41)}
    assert all(abs(v - variance_of_newest(P, X, i, n)) < 1e-12 for (i, n), v in got.items())
    sizes = {r.i: r.n for r in est.sample_sizes(est.variance_by_size(p, x, 40), 40).collect()}
    assert sizes[4] == 40 and sizes[1] < 40 and sizes[1] != sizes[3]


def test_every_object_is_a_row_of_its_table(spark):
    v = {"id": 1, "span": [1, 2], "none": None, "who": {"list": [{"link": "l0", "score": 1, "ev": [{"d": "x"}]}, {"link": 'a"b', "score": 0.5, "mix": [1, {"k": 2}]}]}, "prov": [[{"d": "y"}, {"d": "z"}]], "per:title": {}, "a.b": {"c d": True}}
    docs = nested.documents(spark.createDataFrame([("k", json.dumps(v))], "key string, params string"), ["key"], "params")
    nodes = nested.objects(docs, ["key"])
    got = {r.path: r for r in nested.rows(nodes, F.lit("t"), F.col("key")).collect()}
    assert len(got) == 10 and len({r.row_id for r in got.values()}) == 10
    parents = {p: next((q for q, x in got.items() if x.row_id == r.parent_id), None) for p, r in got.items()}
    assert parents == {r.path: r.parent_path for r in nodes.collect()}
    assert got["$"].parent_id is None and got["$"].values == {"id": "1", "span": "[1,2]", "none": None}
    assert got["$.who.list[1]"].values == {"link": 'a"b', "score": "0.5", "mix": '[1,{"k":2}]'} and got["$.prov[0][1]"].ordinal == 1
    tables = nested.child_tables(nodes, F.lit("t"), F.col("key"))
    assert set(tables) == {r.pattern for r in got.values()}
    items = tables["$.who.list[]"].orderBy("ordinal").collect()
    assert [(r["value.link"], r["value.score"], r.parent_id) for r in items] == [("l0", 1.0, got["$.who"].row_id), ('a"b', 0.5, got["$.who"].row_id)]
    assert [r["value.c d"] for r in tables["$.a.b"].collect()] == [True] and tables["$.per:title"].count() == 1


def test_objects_of_both_tables_have_parents_and_candidates_are_among_them(spark):
    rows = general.p4_objects(spark, SMALL).collect()
    ids = {r.row_id for r in rows}
    assert len(ids) == len(rows) and all(r.parent_id in ids for r in rows if r.path != "$")
    assert {(r.source_table, r.record_key, r.path) for r in rows if r.path != "$"} == {tuple(r)[:3] for r in general.p4_found(spark, SMALL).collect()}
    own = {(r.row_id, r.parent_id, r.ordinal, r.values["link"]) for r in rows if r.pattern == "$.subject.entity.candidates[]" and r.source_table == "evaluation_question"}
    assert own == {(r.row_id, r.parent_id, r.ordinal, r.link) for r in general.p4_candidates(spark, SMALL).collect()}
    assert {r.pattern for r in general.p4_tables(spark, SMALL).collect()} == {r.pattern for r in rows}
