"""Consensus, components, packing and mixing against brute force and invariants."""

import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("claimscope.llm")
from claimscope.llm import components, consensus, mixing, packing  # noqa: E402

SPAN = "struct<lo:int,hi:int>"
RESPONSE = f"assignment_id string, worker_id string, doc_id string, span {SPAN}, created timestamp, mention_type string, weight float, label string"


# consensus


def judged(n_items: int = 300):
    rng = random.Random(3)
    kinds = ["ORG", "PER", "GPE", "DATE"]
    good, bad = [f"g{i}" for i in range(8)], [f"b{i}" for i in range(8)]
    truth, rows = {}, []
    for i in range(n_items):
        truth[i] = rng.choice([*kinds, "NONE"])
        for w in rng.sample(good, 2) + rng.sample(bad, 3):
            right = rng.random() < (0.93 if w in good else 0.15)
            label = truth[i] if right else rng.choice([x for x in [*kinds, "NONE"] if x != truth[i]])
            weight = 0.0 if label == "NONE" else 1.0
            rows.append((f"a{i}{w}", w, f"d{i}", (0, 5), None, rng.choice(kinds) if label == "NONE" else label, weight, "clash"))
    return truth, rows


def test_consensus_beats_majority_and_ranks_annotators(spark):
    truth, rows = judged()
    c = consensus.Consensus(consensus.answers(spark.createDataFrame(rows + rows[:50], RESPONSE)))
    got = {int(r.doc_id[1:]): r.label for r in c.items().collect()}
    votes = defaultdict(Counter)
    for r in rows:
        votes[int(r[2][1:])]["NONE" if r[6] == 0 else r[5]] += 1
    plain = sum(v.most_common(1)[0][0] == truth[i] for i, v in votes.items())
    right = sum(got[i] == t for i, t in truth.items())
    assert set(got) == set(truth) and right > plain and right > 0.9 * len(truth)
    rel = {r.worker_id: r.reliability for r in c.workers().collect()}
    assert min(v for k, v in rel.items() if k[0] == "g") > max(v for k, v in rel.items() if k[0] == "b")


def test_consensus_defined_results(spark):
    rows = [
        ("1", "w1", "d", (0, 1), None, "ORG", 1.0, ""), ("2", "w2", "d", (0, 1), None, "PER", None, ""), ("2", "w2", "d", (0, 1), None, "PER", None, ""),
        ("3", None, "d", (0, 1), None, "PER", 1.0, ""), ("4", "w1", None, (0, 1), None, "PER", 1.0, ""), ("5", "w1", "d", None, None, "PER", 1.0, ""), ("6", "w1", "e", (0, 1), None, None, 1.0, ""), ("7", "w1", "f", (0, 1), None, None, 0.0, ""),
    ]
    c = consensus.Consensus(consensus.answers(spark.createDataFrame(rows, RESPONSE)))
    items = {r.doc_id: r for r in c.items().collect()}
    assert set(items) == {"d", "f"} and items["d"].label == "ORG" and items["d"].n_workers == 2 and items["f"].label == "NONE" and items["f"].agreement is None
    empty = consensus.Consensus(consensus.answers(spark.createDataFrame([], RESPONSE)))
    assert empty.items().count() == 0 and empty.workers().count() == 0
    assert consensus.krippendorff(consensus.answers(spark.createDataFrame([], RESPONSE))).first()["alpha"] is None


def test_weights_as_a_table_give_the_same_consensus(spark):
    votes = consensus.answers(spark.createDataFrame(judged()[1], RESPONSE))
    here, joined = consensus.Consensus(votes), consensus.Consensus(votes, broadcast_cells=0)
    assert here.small and not joined.small and here.rounds == joined.rounds
    rounded = lambda c: {(r.doc_id, r.label, r.n_workers, round(r.agreement, 9), round(r.margin, 9)) for r in c.items().collect()}
    assert rounded(here) == rounded(joined)
    people = lambda c: {(r.worker_id, r.n_answers, r.n_judged, round(r.reliability, 9)) for r in c.workers().collect()}
    assert people(here) == people(joined)


def test_agreement_is_between_different_annotators(spark):
    rows = [("1", "w1", "d", (0, 1), None, "ORG", 1.0, ""), ("2", "w1", "d", (0, 1), None, "ORG", 1.0, ""), ("3", "w2", "d", (0, 1), None, "PER", 1.0, "")]
    votes = consensus.answers(spark.createDataFrame(rows, RESPONSE))
    r = consensus.Consensus(votes).items().first()
    assert (r.n_workers, r.n_answers, r.agreement) == (2, 3.0, 0.0)
    alpha = consensus.krippendorff(votes).first()
    assert alpha.n_answers == 2 and alpha.observed_disagreement == 1.0


def test_alpha_of_perfect_agreement(spark):
    rows = [(f"{i}{w}", w, f"d{i}", (0, 1), None, "ORG" if i % 2 else "PER", 1.0, "") for i in range(10) for w in ("a", "b")]
    assert consensus.krippendorff(consensus.answers(spark.createDataFrame(rows, RESPONSE))).first()["alpha"] == pytest.approx(1.0)


# components


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "braid", "random", "star", "none"])
def test_components_match_union_find(spark, shape):
    rng = random.Random(4)
    pairs = {"chain": [(i, i + 1) for i in range(200)], "braid": [(x, x // 2 + 1000 * (x % 3 == 0)) for x in range(1, 500)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "star": [(0, i) for i in range(1, 300)] + [(1000, 1001)], "none": []}[shape]
    df = spark.createDataFrame([*pairs, *pairs[:5], (None, 3), (7, 7)], "u long, v long")
    want = brute([p for p in pairs if p[0] != p[1]])
    for few in (0, components.FEW_EDGES):  # all rounds over tables, and all in one task
        got = components.components(df, few).collect()
        assert len(got) == len(want) and {r.id: r.root for r in got} == want


def test_hot_nodes_are_split(spark):
    """Stars around a least and around a greatest node: the joins of both rounds split the hot node."""
    lower = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "16k"}
    before = {k: spark.conf.get(k, None) for k in lower}
    rest = spark.range(3000).selectExpr("200000 + 3 * id AS u", "200000 + 3 * id + 1 AS v")
    least = spark.range(1, 40000).selectExpr("id AS u", "0L AS v").union(rest).union(rest.selectExpr("u + 2", "v")).repartition(8)
    greatest = spark.range(1, 40000).selectExpr("100000L AS u", "id AS v").union(rest).union(rest.selectExpr("u + 2", "v")).repartition(8)
    plan = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]
    try:
        for k, v in lower.items():
            spark.conf.set(k, v)
        stars = components._Stars(least)
        low = stars._keep(stars.edges.groupBy("u").agg(components.F.min("v").alias("m")), "least")
        around = stars.edges.join(low.select(components.F.col("u").alias("v"), "m"), "v", "left")
        assert "skew=true" in plan(around)
        assert "skew=true" in plan(components._Stars(greatest).small_star(greatest))
        assert {r.root for r in components.components(greatest).filter("id < 200000").collect()} == {1}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_mention_groups(spark):
    m = [
        (1, "d", (0, 1), (5, 6), "x"), (1, "d", (5, 6), (5, 6), "x"), (1, "e", (2, 3), (9, 10), "x"), (1, "e", (4, 5), None, "x"), (1, "c", (7, 8), (7, 8), "x"),
        (2, "d", (0, 1), (0, 1), "x"), (None, "d", (0, 1), (5, 6), "x"), (1, "d", (0, 1), (5, 6), "x"),
    ]
    k = [(1, "d", (0, 1), "wiki:A"), (1, "e", (4, 5), "wiki:A"), (1, "c", (7, 8), "Wiki:null"), (1, "e", (2, 3), "wiki:NULL"), (2, "d", (0, 1), "wiki:A"), (1, "z", (0, 1), "wiki:A"), (1, "c", (7, 8), "")]
    mentions = spark.createDataFrame(m, f"submission_id int, doc_id string, span {SPAN}, canonical_span {SPAN}, id string")
    links = spark.createDataFrame(k, f"submission_id int, doc_id string, span {SPAN}, link_name string")
    got = {tuple(r) for r in components.mention_groups(mentions, links).collect()}
    assert got == {(1, "d", 0, 1, "d", 0, 1), (1, "d", 5, 6, "d", 0, 1), (1, "e", 4, 5, "d", 0, 1)}
    assert components.mention_groups(mentions.limit(0), links.limit(0)).count() == 0


# packing


def first_fit_decreasing(lengths, cap):
    free = []
    for n in sorted(lengths, reverse=True):
        for i, f in enumerate(free):
            if f >= n:
                free[i] -= n
                break
        else:
            free.append(cap - n)
    return len(free)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 3, 7, 20, 33, 64, 90, 100, 150, 333]), "x") for i in range(2000)] + [(9000 + i, 50, "x") for i in range(1500)] + [(99999, None, "x")]
    items = spark.createDataFrame(sizes, "doc_id long, n_tokens long, profile string")
    profiles = spark.createDataFrame([("a", 100), ("b", 128), ("a", 100)], "profile string, capacity_tokens int")
    rows = packing.pack(items, profiles).collect()
    for name, cap in (("a", 100), ("b", 128)):
        own = [r for r in rows if r.profile == name]
        whole = Counter()
        fill = Counter()
        for r in own:
            whole[r.doc_id] += r.n_tokens
            fill[r.container_id] += r.n_tokens
            assert r.n_tokens <= cap and r.capacity_tokens == cap
        assert dict(whole) == {i: n for i, n, _ in sizes if n}
        assert max(fill.values()) <= cap
        assert all(cap - fill[r.container_id] == r.unused_tokens for r in own)
        pieces = Counter(r.doc_id for r in own)
        assert all(pieces[i] == -(-n // cap) for i, n, _ in sizes if n)
        assert len(fill) <= first_fit_decreasing([r.n_tokens for r in own], cap)
    assert packing.pack(items.limit(0), profiles).count() == 0


# mixing


def test_mixture_shares_and_repeats(spark):
    rng = random.Random(6)
    docs = [(i, "word " * rng.randint(5, 60) + str(i), "big") for i in range(600)] + [(1000 + i, "term " * rng.randint(5, 60) + str(i), "small") for i in range(40)]
    docs += [(5000, docs[0][1], "big"), (5001, docs[0][1], "small"), (6000, None, "big"), (6001, "", "big"), (6002, "no source", None), (6003, "other", "unlisted")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mixture(documents, targets)
    rows, report = chosen.collect(), {r.source: r for r in shares.collect()}
    assert len({r.doc_id for r in rows}) == len(rows)
    assert not {5000, 5001, 6000, 6001, 6002, 6003} & {r.doc_id for r in rows}
    assert all(r.repeats <= (1 if r.source == "big" else 3) for r in rows)
    assert report["gone"].actual_share == 0
    assert report["big"].actual_share == pytest.approx(2 / 3, abs=0.02) and report["small"].actual_share == pytest.approx(1 / 3, abs=0.02)
    small = [r.repeats for r in rows if r.source == "small"]
    assert max(small) - min(small) <= 1  # complete epochs first
    again = {(r.doc_id, r.repeats) for r in mixing.mixture(documents.repartition(7), targets)[0].collect()}
    assert again == {(r.doc_id, r.repeats) for r in rows}
    empty, none = mixing.mixture(documents.limit(0), targets)
    assert empty.count() == 0 and {r.tokens for r in none.collect()} == {0}


def test_heavier_texts_come_first_more_often(spark):
    """The first key of each pair falls to the heavier text with probability w1 / (w1 + w2)."""
    from pyspark.sql import functions as F

    df = spark.range(20000).select((-F.log(mixing.uniform("a", F.col("id"))) / 3.0 < -F.log(mixing.uniform("b", F.col("id"))) / 1.0).alias("first"))
    assert df.agg(F.avg(F.col("first").cast("double"))).first()[0] == pytest.approx(0.75, abs=0.015)
