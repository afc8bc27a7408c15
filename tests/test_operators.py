"""Operators against closed forms, brute force and properties."""

import random

import pytest
from pyspark.sql import functions as F

from claimscope.functions import dictionaries as dic
from claimscope.functions import scalars as sc
from claimscope.operators import annotation, distributions, estimators, ordering, ranges, slotfilling, states
from claimscope.operators.questions import relation_questions


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


# estimators: closed forms


def systems(spark, *dists):
    return spark.createDataFrame([(i, x, p) for i, d in enumerate(dists) for x, p in d.items()], "i int, x string, p double")


def samples(spark, *sizes):
    return spark.createDataFrame([(j, "a", 1.0) for j, n in enumerate(sizes) for _ in range(n)], "j int, x string, f double")


def matrix(df, value="w"):
    return {(r.i, r.j): r[value] for r in df.collect()}


def test_weights_of_identical_and_disjoint_systems(spark):
    X = samples(spark, 10, 50, 100)
    same = systems(spark, *[{"a": 0.5, "b": 0.5}] * 3)
    w = matrix(estimators.weights(same, X))
    assert all(w[i, j] == pytest.approx([10, 50, 100][j] / 160) for i in range(3) for j in range(3))
    apart = systems(spark, {"a": 1.0}, {"b": 1.0}, {"c": 1.0})
    assert matrix(estimators.weights(apart, X)) == {(i, i): 1.0 for i in range(3)}
    assert matrix(estimators.weights(apart, X, "uniform"))[0, 2] == pytest.approx(1 / 3)
    assert matrix(estimators.weights(apart, X, "size"))[1, 2] == pytest.approx(100 / 160)


def test_proposal_and_merged_labels(spark):
    P = systems(spark, {"a": 1.0}, {"b": 1.0}, {"c": 1.0})
    W = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 1, 1.0), (2, 2, 0.9)], "i int, j int, w double")
    q = {(r.i, r.x): r.q for r in estimators.proposal(W, P).collect()}
    assert q == {(0, "a"): 0.5, (0, "b"): 0.5, (1, "b"): 1.0, (2, "c"): 0.9}
    Y = spark.createDataFrame([(0, "a", 0), (0, "b", 0), (0, "c", 1), (1, "a", 1), (1, "b", None), (2, "a", 0)], "i int, x string, g int")
    assert {r.x: r.g for r in estimators.merged_labels(Y).collect()} == {"a": 1, "b": 0, "c": 1}


def test_estimates_recover_generated_precision_and_recall(spark):
    rng = random.Random(7)
    true, false = [f"t{i}" for i in range(400)], [f"f{i}" for i in range(800)]
    wanted = [(0.8, 0.5), (0.4, 0.7), (0.6, 0.3)]
    P, X, Y = [], [], []
    for i, (p, r) in enumerate(wanted):
        right = rng.sample(true, int(r * 400))
        mine = right + rng.sample(false, int(len(right) * (1 - p) / p))
        P += [(i, x, 1 / len(mine)) for x in mine]
        X += [(i, x, float(x[0] == "t")) for x in rng.sample(mine, 150)]
        Y += [(i, x, int(x in set(right))) for x in true]
    P, X, Y = spark.createDataFrame(P, "i int, x string, p double"), spark.createDataFrame(X, "j int, x string, f double"), spark.createDataFrame(Y, "i int, x string, g int")
    P0 = spark.createDataFrame([(x, 1.0) for x in true + false], "x string, p0 double")
    for got in (estimators.simple(X, P0, Y), estimators.joint(P, P0, X, Y)):
        for row in got.collect():
            assert row.precision == pytest.approx(wanted[row.i][0], abs=0.1) and row.recall == pytest.approx(wanted[row.i][1], abs=0.1)
    W = estimators.weights(P, X)
    assert all(r.s == pytest.approx(1) for r in W.groupBy("i").agg(F.sum("w").alias("s")).collect())
    v = {r.i: r.variance for r in estimators.variance(P, X, W, estimators.proposal(W, P)).collect()}
    assert all(0 < x < 0.01 for x in v.values())


def test_sample_size_bisection(spark):
    curve = lambda f, target: spark.createDataFrame([(1, n, float(f(n))) for n in range(1, target + 1)], "i int, n int, variance double")
    size = lambda f, target, eps=5e-4: estimators.sample_sizes(curve(f, target), target, eps).first()["n"]
    assert size(lambda n: 1 / n, 40) == 40
    assert size(lambda n: 0.2 / n, 40, 1e-12) == 8
    assert size(lambda n: 0.0, 40, 1e-12) == 2
    assert size(lambda n: 0.2 / n, 40) in range(7, 10)


def test_incremental_weights_equal_a_full_computation(spark):
    P = systems(spark, {"a": 0.5, "b": 0.5}, {"a": 0.2, "c": 0.8}, {"b": 0.1, "c": 0.4, "d": 0.5})
    X = samples(spark, 10, 50, 100)
    old = estimators.weights(P.filter("i < 2"), X.filter("j < 2"))
    new, full = estimators.updated_weights(old, P, X, 2), estimators.weights(P, X)
    assert {k: pytest.approx(v) for k, v in matrix(full).items()} == matrix(new)
    q = {(r.i, r.x): r.q for r in estimators.updated_proposal(estimators.proposal(old, P.filter("i < 2")), old, new, P, 2).collect()}
    assert q == {(r.i, r.x): pytest.approx(r.q) for r in estimators.proposal(full, P).collect()}


def test_bootstrap_intervals_hold_the_score(spark):
    rng = random.Random(11)
    P, X, Y = [], [], []
    for i, right in enumerate((0.8, 0.4)):
        mine = [f"t{n}" for n in range(int(100 * right))] + [f"f{i}{n}" for n in range(100 - int(100 * right))]
        P += [(i, x, 0.01) for x in mine]
        X += [(i, x, float(x[0] == "t")) for x in rng.sample(mine, 60)]
        Y += [(i, x, 1) for x in mine if x[0] == "t"]
    P, X, Y = spark.createDataFrame(P, "i int, x string, p double"), spark.createDataFrame(X, "j int, x string, f double"), spark.createDataFrame(Y, "i int, x string, g int")
    truth = spark.createDataFrame([(f"t{n}",) for n in range(120)], "x string")
    P0 = P.select("x").union(truth).distinct().withColumn("p0", F.lit(1.0))
    for rows in (estimators.simple_intervals(X, P0, Y, truth, 40, "s").collect(), estimators.joint_intervals(P, P0, X, Y, truth, 40, "s").collect()):
        assert len(rows) == 2
        for r in rows:
            assert r.precision_low <= r.precision <= r.precision_high and r.recall_low <= r.recall <= r.recall_high and r.f1_low <= r.f1_high
            assert 0.01 < r.precision_high - r.precision_low < 0.4


# draws


def test_draws_follow_the_distribution(spark):
    p = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}
    df = spark.createDataFrame(list(p.items()), "x string, p double")
    drawn = distributions.draw_with_replacement(df, ["x"], "p", 20000, "seed", buckets=3)
    n = {r.x: r.n for r in drawn.groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(n.values()) == 20000 and all(n[x] / 20000 == pytest.approx(p[x], abs=0.02) for x in p)
    few = distributions.draw_without_replacement(df.withColumn("k", F.lit(1)), ["k"], ["x"], "p", 9, "s")
    assert few.count() == 4
    again = distributions.draw_without_replacement(df.repartition(5).withColumn("k", F.lit(1)), ["k"], ["x"], "p", 2, "s")
    assert {r.x for r in again.collect()} == {r.x for r in few.filter("rank <= 2").collect()}
    uniform = distributions.draw_uniformly_with_replacement(df, ["x"], 8000, "u").groupBy("x").count().collect()
    assert all(abs(r["count"] / 8000 - 0.25) < 0.03 for r in uniform)


def test_kl_of_equal_distributions_is_zero_and_null_without_mass(spark):
    p = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.0)], "x string, p double")
    assert distributions.kl_divergence(p, p, ["x"]).first()[0] == pytest.approx(0)
    assert distributions.kl_divergence(p, p.filter("x <> 'b'"), ["x"]).first()[0] is None


# ranges


@pytest.mark.parametrize("width", [1, 7, 256])
def test_range_joins_equal_brute_force(spark, width):
    rng = random.Random(8)
    make = lambda n: [(rng.choice("xy"), a, a + rng.randint(0, 12)) for a in (rng.randint(0, 80) for _ in range(n))]
    A, B = sorted(set(make(60))), sorted(set(make(60)))
    a, b = spark.createDataFrame(A, "k string, lo int, hi int"), spark.createDataFrame(B, "k string, o_lo int, o_hi int")
    got = [tuple(r) for r in ranges.overlapping(a, b, ["k"], width=width).select("k", "lo", "hi", "o_lo", "o_hi").collect()]
    want = {(k, l, h, m, n) for k, l, h in A for q, m, n in B if k == q and l < n and m < h and l < h and m < n}
    assert len(got) == len(set(got)) and set(got) == want
    got = [tuple(r) for r in ranges.contained_in(a, b, ["k"], width=width).select("k", "lo", "hi", "o_lo", "o_hi").collect()]
    want = {(k, l, h, m, n) for k, l, h in A for q, m, n in B if k == q and m <= l and h <= n and l < h}
    assert len(got) == len(set(got)) and set(got) == want


def test_range_join_plans_have_no_nested_loop(spark):
    a = spark.range(10).selectExpr("'x' AS k", "id AS lo", "id + 3 AS hi")
    plan = ranges.overlapping(a, a.toDF("k", "o_lo", "o_hi"), ["k"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_next_at_or_after(spark):
    p = spark.createDataFrame([("d", 5), ("d", 6), ("d", 50), ("e", 1)], "k string, at int")
    s = spark.createDataFrame([("d", 5, 9), ("d", 5, 7), ("d", 20, 21), ("f", 1, 2)], "k string, lo int, hi int")
    got = {(r.k, r.at): (r.next_lo, r.next_hi) for r in ranges.next_at_or_after(p, s, ["k"], "at", "lo", ["hi"]).collect()}
    assert got == {("d", 5): (5, 7), ("d", 6): (20, 21), ("d", 50): (None, None), ("e", 1): (None, None)}


# ordering


def test_mode_counts_nulls_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "b"), (2, "b"), (2, "a"), (3, None), (3, "z")], "k int, v string")
    assert {r.k: r.mode for r in ordering.mode_with_nulls(df, ["k"], "v").collect()} == {1: None, 2: "a", 3: "z"}


def test_latest_and_keep_newest(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (1, 7, "a"), (2, None, "q")], "k int, t int, v string")
    assert {r.k: r.v for r in ordering.latest(df, ["k"], "t", ["v"]).collect()} == {1: "y", 2: "q"}
    kept = ordering.keep_newest(df, ["k"], "t", "v", F.lit(1)).filter("NOT ignored").collect()
    assert {(r.k, r.v) for r in kept} == {(1, "y"), (2, "q")}


# scalars


@pytest.mark.parametrize("text, plain", [("a%27b%", "a'b%"), ("100%", "100%"), ("a+b%27c", "a+b'c"), ("", ""), ("%C3%A9", "é")])
def test_unquote(spark, text, plain):
    assert one(spark, sc.unquote(F.col("x")), x=text) == plain


@pytest.mark.parametrize("text, want", [("ABC.1:3-9", ("ABC.1", 3, 9)), ("ABC:3-", None), ("x y:1-2", None), (None, None)])
def test_provenance(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(sc.provenance(F.col("x")).alias("p")).first()["p"]
    assert (tuple(got) if got else None) == want


def test_scalar_forms(spark):
    assert one(spark, sc.wikify(F.col("x")), x="a b[c]/d|e") == "a_b_c__d_e"
    assert one(spark, sc.team_of(F.col("x")), x="SF_UWash3") == "UWash"
    assert one(spark, sc.partial_date(F.col("y"), F.lit(None).cast("int"), F.col("d")), y=2016, d=5) == "2016-XX-05"
    assert one(spark, sc.marked(F.col("s"), F.lit(10), F.lit(12), F.lit(13), F.lit(15), F.lit(16)), s="abcdefgh") == "ab*c*de^f^gh"
    assert one(spark, sc.marked(F.col("s"), F.lit(10), F.lit(15), F.lit(16), F.lit(12), F.lit(13)), s="abcdefgh") == "ab^c^de*f*gh"
    assert [one(spark, sc.frequency_bin(F.col("n")), n=n) for n in (3, 100, 101)] == ["low", "med", "high"]
    assert one(spark, sc.histogram_bin(F.col("v"), [0, 1, 2]), v=2) == 1
    assert one(spark, F.struct(*sc.whole_range(F.lit(0.25), F.lit(-1.0), F.lit(8)))) == (2, 0)


@pytest.mark.parametrize(
    "gloss, text, suggested, lo, hi, want",
    [
        ("South and Africa", "South Africa", "South Africa", 729, 741, "Replace with suggested"),
        ("Anne McClain", "Anne  McClain", "Anne McClain", 2367, 2380, "Replace gloss"),
        ("Rousseff", "Rousseff", "Rousseff", 1339, 1347, "Correct"),
        ("NSA", None, None, None, None, "Delete"),
        ("America's First", "America’s First", "America's First", 878, 917, "Replace gloss"),
        ("P&G", "P&amp;G", "P&G", 655, 662, "Replace gloss"),
    ],
)
def test_sanitised(spark, gloss, text, suggested, lo, hi, want):
    df = spark.createDataFrame([(gloss, text, suggested, lo, hi)], "g string, t string, s string, lo int, hi int")
    assert df.select(annotation.sanitised(*map(F.col, ("g", "t", "s", "lo", "hi")))).first()[0] == want


def test_dictionaries(spark):
    assert dic.ALIASES["per:cities_of_residence"] == "per:place_of_residence" and dic.ALIASES["no_relation"] == "no_relation"
    assert ("ORG", "PER") not in dic.pair_types() and ("PER", "TITLE") in dic.pair_types()
    cases = [("per:parents", "PER", "PER", True), ("per:employee_or_member_of", "PER", "ORG", True), ("gpe:member_of", "GPE", "ORG", False), ("org:founded_by", "ORG", "ORG", True), ("org:founded_by", "ORG", "PER", False)]
    df = spark.createDataFrame(cases, "r string, s string, o string, want boolean")
    assert df.filter(dic.is_canonical(F.col("r"), F.col("s"), F.col("o")) != F.col("want")).count() == 0
    assert one(spark, dic.inverse(F.lit("org:members"), F.lit("GPE"))) == "gpe:member_of"
    assert one(spark, dic.inverse(F.lit("per:title"), F.lit("TITLE"))) is None


# annotation


def test_fleiss_example(spark):
    table = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    votes = [(i, c) for i, row in enumerate(table) for c, n in enumerate(row) for _ in range(n)]
    k = annotation.fleiss_kappa(spark.createDataFrame(votes, "item int, label int"), ["item"], "label", 14).first()
    assert (k.n_items, k.raters) == (10, 14) and k.kappa == pytest.approx(0.2099, abs=1e-3)


def test_winning_spans(spark):
    rows = [("d", 0, 5, "PER", 3.0, 4.0), ("d", 0, 8, "ORG", 3.0, 4.0), ("d", 6, 7, "PER", 1.0, 4.0), ("d", 20, 22, "PER", 1.0, 4.0), ("d", 30, 31, "PER", 4.0, 4.0)]
    # a winner without majority is not replaced by a shorter span that has it, and its window is lost
    rows += [("e", 0, 9, "PER", 1.0, 4.0), ("e", 2, 4, "PER", 4.0, 4.0), ("e", 9, 12, "PER", 4.0, 4.0)]
    df = spark.createDataFrame(rows, "doc_id string, lo int, hi int, mention_type string, votes double, of double")
    got = {(r.doc_id, r.lo, r.hi): (r.win_lo, r.win_hi, r.win_type) for r in annotation.winning_spans(df).collect()}
    assert got == {("d", 0, 5): (0, 8, "ORG"), ("d", 0, 8): (0, 8, "ORG"), ("d", 6, 7): (0, 8, "ORG"), ("d", 30, 31): (30, 31, "PER"), ("e", 9, 12): (9, 12, "PER")}


VOTE = "assignment_id string, doc_id string, mention_type string, lo int, hi int, weight double, gloss string, c_lo int, c_hi int, question_batch_id int, question_id string"


def test_the_inner_span_gets_the_pair(spark):
    rows = [("a1", "d", "PER", 0, 10, 1.0), ("a2", "d", "PER", 2, 5, 1.0), ("a3", "d", "ORG", 1, 4, 1.0), ("a4", "d", "PER", 3, 4, 0.5)]
    got = {(r.lo, r.hi): (r.pairs, r.votes) for r in annotation.span_clique_counts(spark.createDataFrame(rows, "assignment_id string, doc_id string, mention_type string, lo int, hi int, weight double")).collect()}
    assert got == {(2, 5): (1, 2.0)}


def test_span_cliques_equal_the_self_join(spark):
    rng = random.Random(9)
    rows = [(f"a{i}", "d", "PER", lo, lo + rng.randint(1, 4), 1.0) for i, lo in enumerate(rng.randint(0, 6) for _ in range(60))]
    got = {(r.lo, r.hi): r.pairs for r in annotation.span_clique_counts(spark.createDataFrame(rows, "assignment_id string, doc_id string, mention_type string, lo int, hi int, weight double")).collect()}
    want: dict = {}
    for a in rows:
        for b in rows:
            if b[3] <= a[3] and a[4] <= b[4] and a[3:5] != b[3:5] or a[3:5] == b[3:5] and a[0] < b[0]:
                want[a[3:5]] = want.get(a[3:5], 0) + 1
    assert got == want


def test_merged_mentions_by_hand(spark):
    """Question q has three assignments. [0, 4) is given by two and lies in the [0, 9) of the third: three pairs, three
    votes of three; [0, 9) has no pair. [20, 25) is given twice with another canonical span each, of which only that at
    [0, 4) has a winner."""
    vote = lambda a, lo, hi, gloss, c: (a, "d", "PER", lo, hi, 1.0, gloss, *c, 1, "q")
    rows = [vote("a1", 0, 4, "Mara", (0, 4)), vote("a2", 0, 4, "Mara", (0, 4)), vote("a3", 0, 9, "Mara Velt", (0, 9)), vote("a1", 20, 25, "she", (0, 4)), vote("a2", 20, 25, None, (0, 4)), vote("a3", 40, 41, "x", (40, 41))]
    got = {(r.lo, r.hi): (r.mention_type, r.gloss, r.c_lo, r.c_hi, round(r.weight, 6)) for r in annotation.merge_mentions(spark.createDataFrame(rows, VOTE)).collect()}
    assert got == {(0, 4): ("PER", "Mara", 0, 4, 1.0), (20, 25): ("PER", "she", 0, 4, round(2 / 3, 6))}
    assert annotation.merge_mentions(spark.createDataFrame([], VOTE)).count() == 0


def test_facts_need_more_than_half_of_the_expected_votes(spark):
    v = spark.createDataFrame([("k", "x", 1.0), ("k", "x", 1.0), ("k", "y", 1.0), ("j", "x", 1.0), ("j", "y", 1.0), (None, "x", 1.0)], "key string, fact string, weight double")
    asked = spark.createDataFrame([("k", 3.0), ("j", 2.0)], "key string, of double")
    assert [(r.key, r.fact, round(r.weight, 3)) for r in annotation.merge_facts(v, ["key"], ["fact"], asked).collect()] == [("k", "x", 0.667)]


def test_selective_payload_versions(spark):
    new = '{"subject": {"gloss": "A", "type": "PER", "span": [1, 3], "entity": {"link": "wiki:A"}}, "object": {"gloss": "B", "type": "ORG", "span": ["5", "9"]}}'
    old = '{"subject": {"gloss": "A", "type": {"name": "PER"}, "span": [1, 3]}, "object": {"gloss": "B", "type": {"name": "ORG"}, "span": [9, 9]}}'
    q = spark.createDataFrame([(1, "n", new), (1, "o", old), (1, "c", new[:40]), (1, "z", None)], "batch_id int, id string, params string")
    rows = {(r.id, r.role): (r.lo, r.hi, r.mention_type, r.link) for r in annotation.question_arguments(q).collect()}
    assert rows == {("n", "subject"): (1, 3, "PER", "wiki:A"), ("n", "object"): (5, 9, "ORG", None), ("o", "subject"): (1, 3, "PER", None)}


def test_questions_flip_and_skip_asked(spark):
    s = spark.createDataFrame([("d", 0, 1, 5, 6), ("d", 5, 6, 0, 1), ("e", 0, 1, 5, 6)], "doc_id string, s_lo int, s_hi int, o_lo int, o_hi int")
    m = spark.createDataFrame([(x, 0, 1, "ORG", "gloss:Acme") for x in "de"] + [(x, 5, 6, "PER", "Mara") for x in "de"], "doc_id string, lo int, hi int, mention_type string, gloss string")
    asked = spark.createDataFrame([("e", 5, 0)], "doc_id string, s_lo int, o_lo int")
    rows = relation_questions(s, m, asked).collect()
    assert len(rows) == 1 and (rows[0].doc_id, rows[0].s_lo, rows[0].o_lo) == ("d", 5, 0) and '"gloss":"Acme"' in rows[0].params


# slot filling


def test_slot_filling_scores(spark):
    out = spark.createDataFrame([("r1", "e", 1, "a", 1), ("r1", "e", 1, "b", 0), ("r2", "e", 2, "a", 1), ("r2", "e", 3, "c", 2), ("r2", "e", 3, "c", 2)], "run_id string, entity string, prov int, slot_value string, eq int")
    s = {r.run_id: (r.s, r.c, r.t) for r in slotfilling.entity_scores(out, out, "anydoc").collect()}
    assert s == {"r1": (2, 1, 2), "r2": (2, 2, 2)}
    pool = {r.team: r.n_gold for r in slotfilling.leave_out_pool(out, out, "anydoc", F.col("run_id")).collect()}
    assert pool == {"r1": 2, "r2": 1}
    with pytest.raises(ValueError):
        slotfilling.key_columns("other")


def test_states(spark):
    q = spark.createDataFrame([(1, "done"), (1, "error"), (2, None), (2, "odd")], "batch_id int, state string")
    assert states.unknown_states(q, "question").count() == 2
    got = sorted(str(r.state) for r in states.revoked(q, spark.createDataFrame([(1,)], "batch_id int")).collect())
    assert got == ["None", "error", "odd", "revoked"]
