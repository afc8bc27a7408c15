"""Sentences, glyphs and encodings: fixtures, round trips and defined results."""

import random
from collections import Counter

import pytest

pytest.importorskip("claimscope.llm")
from claimscope.llm import encoding, glyphs, sentences  # noqa: E402

SPAN = "struct<lo:int,hi:int>"


# sentences


def corpus() -> list[str]:
    """Small texts of one style: abbreviations inside, paragraphs at reliable boundaries."""
    rng = random.Random(1)
    names = ["Mara Velt", "Iva Kolm", "Tor Brane", "Sil Onda", "Pia Rost", "Jon Werd"]
    towns = ["Lund", "Perro", "Galt", "Mirv"]
    kinds = [
        lambda: f"Dr. {rng.choice(names)} left {rng.choice(towns)} at {rng.randint(1, 9)}.{rng.randint(10, 59)} p.m. on Jan. {rng.randint(1, 28)}, 1999.",
        lambda: f"The court of {rng.choice(towns)} heard {rng.choice(names)} vs. {rng.choice(names)} in case No. {rng.randint(1, 99)}.",
        lambda: f'"Is {rng.choice(names)} still in {rng.choice(towns)}?" asked {rng.choice(names)}.',
        lambda: f"What a day for {rng.choice(towns)}!",
        lambda: f"Cf. sec. {rng.randint(1, 9)}.{rng.randint(1, 9)} of the report by {rng.choice('ABC')}. {rng.choice('DEF')}. {rng.choice(names)}.",
    ]
    return ["\n\n".join(" ".join(rng.choice(kinds)() for _ in range(rng.randint(1, 4))) for _ in range(3)) for _ in range(300)]


def truth(text: str) -> set[tuple[int, int]]:
    """Spans by the templates: a sentence of the corpus ends where a known beginning follows."""
    import re

    out, at = set(), 0
    starts = re.compile(r'(?<=[.!])\s+(?=Dr\. [A-Z][a-z]+ [A-Z][a-z]+ left|The court|"Is|What a day|Cf\.)')
    for m in starts.finditer(text):
        out.add((at, m.start()))
        at = m.end()
    return out | {(at, len(text))}


def test_sentences_of_held_out_texts(spark):
    texts = corpus()
    rows = [(f"d{i}", t) for i, t in enumerate(texts)]
    found = sentences.sentences(spark.createDataFrame(rows, "id string, gloss string")).collect()
    got = {(r.doc_id, r.span_lo, r.span_hi) for r in found}
    want = {(i, *s) for i, t in rows for s in truth(t)}
    assert len(got) == len(found)
    assert len(got & want) / len(got | want) > 0.97


def test_sentence_layout():
    text = "Heading of the day\n\nOne sentence that was\nbroken by hand. \n\n1. Prath, chair\n2. Wenne, clerk\n- Vesa (Orle)"
    assert [text[a:b] for a, b in sentences.blocks(text)] == ["Heading of the day", "One sentence that was\nbroken by hand.", "1. Prath, chair", "2. Wenne, clerk", "- Vesa (Orle)"]


def test_sentences_null_empty_repeats_and_clashing_columns(spark):
    long = "Word word. " * 20000
    rows = [("a", None, 1), ("b", "", 1), ("c", " \n\n ", 1), ("d", "Hi there.", 1), ("d", "Hi there.", 1), (None, "No id.", 1), ("e", long, 1)]
    out = sentences.sentences(spark.createDataFrame(rows, "id string, gloss string, doc_id int")).collect()
    by = Counter(r.doc_id for r in out)
    assert by["d"] == 1 and by[None] == 1 and {"a", "b", "c"}.isdisjoint(by)
    ends = sorted((r.span_lo, r.span_hi) for r in out if r.doc_id == "e")
    assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:])) and ends[-1][1] == len(long.rstrip())
    assert sentences.sentences(spark.createDataFrame([], "id string, gloss string")).count() == 0


# glyphs


@pytest.mark.parametrize(
    "raw, folded",
    [("Ｙｖｋｉｎ", "Yvkin"), ("Élra", "Élra"), ("R‌in﻿", "Rin"), ("a b　c", "a b c"), ("ｹﾞﾙ", "ゲル"), ("x²", "x²"), ("ﬁ", "ﬁ"), ("⾦", "金"), ("", "")],
)
def test_fold(raw, folded):
    assert glyphs.fold(raw) == folded
    assert glyphs.fold(folded) == folded


def test_same_reading(spark):
    responses = [
        ("1", "d", (0, 7), "Нalmіra"),  # mixed script
        ("2", "d", (0, 7), "Halmira"),  # equal
        ("3", "d", (0, 7), "HALMIRA"),  # visible
        ("4", "d", (0, 7), "Hal​mira"),
        ("5", "d", (8, 13), "Вrаnе"),
        ("6", "d", (8, 13), "Brаno"),
        ("7", "d", (0, 7), None),
        ("8", "x", (0, 7), "Halmira"),
        ("9", "d", (5, 99), "no such span"),
        ("10", "d", (14, 15), "е"),  # one letter, all twins
        ("4", "d", (0, 7), "Hal​mira"),
    ]
    docs = [("d", "Halmira Brane e Halmira Brane e e", "clash"), ("d", "Halmira Brane e Halmira Brane e e", "clash"), ("n", None, "clash")]
    r = spark.createDataFrame(responses, f"assignment_id string, doc_id string, span {SPAN}, gloss string")
    g = spark.createDataFrame(docs, "id string, gloss string, span string")
    vocab = glyphs.vocabulary([g.select("gloss"), r.select("gloss")])
    found = glyphs.same_reading(glyphs.slices(r, g), "gloss", "under", vocab).collect()
    assert sorted(x.assignment_id for x in found) == ["1", "10", "4", "5"]
    assert glyphs.same_reading(glyphs.slices(r.limit(0), g.limit(0)), "gloss", "under", vocab).count() == 0


# encodings


def clean_texts() -> list[str]:
    rng = random.Random(2)
    words = "général été déjà vu à côté où ça élève façon naïve crème brûlée garçon forêt hôtel très près après problème".split()
    russian = "решение принято контора закрыта завод платит институт покидает город сегодня неужели важно словам работает".split()
    out = [" ".join(rng.choice(words) for _ in range(30)) + "." for _ in range(150)]
    return out + [" ".join(rng.choice(russian) for _ in range(30)) + "." for _ in range(150)]


@pytest.mark.parametrize("wrong, right", [("cp1252", "utf-8"), ("cp437", "utf-8"), ("cp1251", "utf-8"), ("latin-1", "cp1251")])
def test_garbled_round_trip(spark, wrong, right):
    clean = clean_texts()
    chosen = [t for t in clean if (right != "cp1251" or t[0] > "а")][:20] if right == "utf-8" else [t for t in clean if t[0] >= "а"][:20]
    garbled = []
    for t in chosen:
        raw = t.encode(right)
        try:
            garbled.append((t, raw.decode(wrong)))
        except UnicodeDecodeError:
            continue
    assert garbled
    rows = [(i, t) for i, t in enumerate(clean)] + [(1000 + i, g) for i, (_, g) in enumerate(garbled)]
    found = {r.doc_id: r.restored for r in encoding.examine(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == {1000 + i for i in range(len(garbled))}
    assert sum(found[1000 + i] == t for i, (t, _) in enumerate(garbled)) >= 0.9 * len(garbled)


def test_encoding_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "plain ascii"), (4, "lost � byte"), (4, "lost � byte")] + [(10 + i, t) for i, t in enumerate(clean_texts()[:40])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, restored string")
    out = encoding.examine(df).collect()
    assert {r.doc_id for r in out} == {4} and all(r.restored is None for r in out)
    assert encoding.examine(df.limit(0)).count() == 0
