"""Orphan references and nested records: brute force and defined results."""

import datetime as dt
import json

from pyspark.sql import functions as F

from claimscope.operators import nested
from claimscope.operators.orphans import Parent, Reference, joined_key, orphan_report, orphans

T = lambda day: dt.datetime(2016, 5, day)


def test_orphans_kinds_and_nulls(spark):
    child = spark.createDataFrame([("1", "a", T(5)), ("2", "b", T(5)), ("3", "c", T(5)), ("4", "d", T(5)), ("5", None, T(5)), ("6", "c", None), ("7", "zz", None), ("2", "b", T(5)), ("8", "A", T(5))], "id string, ref string, at timestamp")
    parent = spark.createDataFrame([("a", T(1), "ok"), ("b", T(9), "ok"), ("b", T(9), "ok"), ("c", T(9), "deleted"), ("d", T(9), "ok"), ("d", T(2), "ok"), (None, T(1), "ok")], "ref string, at timestamp, state string")
    refs = [Reference("child", child, F.col("id"), F.col("ref"), F.col("at"), "parent")]
    rows = {tuple(r) for r in orphans(refs, [Parent("parent", parent, F.col("ref"), F.col("at"), F.col("state") == "deleted")]).collect()}
    assert rows == {("child", "2", "b", "2016-05", "late"), ("child", "3", "c", "2016-05", "deleted"), ("child", "6", "c", None, "deleted"), ("child", "7", "zz", None, "missing"), ("child", "8", "A", "2016-05", "missing")}
    none = orphans(refs, [Parent("parent", parent.limit(0), F.col("ref"), F.col("at"))])
    assert none.filter("kind = 'missing'").count() == none.count() == 7
    assert orphans([Reference("child", child.limit(0), F.col("id"), F.col("ref"), F.col("at"), "parent")], [Parent("parent", parent, F.col("ref"), F.col("at"))]).count() == 0
    assert orphan_report(none).agg(F.sum("n_records")).first()[0] == 7


def test_orphans_merge_join_not_broadcast(spark):
    from claimscope.plans.general import p3_found

    plan = p3_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_hot_reference_is_split(spark, tmp_path):
    """Four of five references have one key; after the run its plan holds a split join."""
    lower = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    spark.range(40000).selectExpr("CAST(id AS string) AS id", "IF(id % 5 < 4, 'hot', CAST(id % 97 AS string)) AS ref", "TIMESTAMP'2016-05-05' AS at").repartition(8).write.parquet(str(tmp_path / "c"))
    child = spark.read.parquet(str(tmp_path / "c"))
    parent = spark.range(97).selectExpr("CAST(id AS string) AS ref", "TIMESTAMP'2016-05-01' AS at")
    before = {k: spark.conf.get(k, None) for k in lower}
    try:
        for k, v in lower.items():
            spark.conf.set(k, v)
        out = orphans([Reference("child", child, F.col("id"), F.col("ref"), F.col("at"), "parent")], [Parent("parent", parent, F.col("ref"), F.col("at"))])
        rows = out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 32000 and {r.missing_key for r in rows} == {"hot"}


def test_joined_key_is_null_if_any_part_is(spark):
    assert [r[0] for r in spark.createDataFrame([(1, "a"), (None, "a"), (1, None)], "x int, y string").select(joined_key(F.col("x"), F.col("y"))).collect()] == ["1|a", None, None]


NESTED = {
    "plain": {"a": {"b": {}}, "l": [{"x": 1}, {"x": {"y": []}}, [[{"z": 2}]], 5], "n": None, "e": [], "per:title": {"n": 1}},
    "top array": [{"a": 1}, [{"b": {}}]],
    "empty": {},
    "scalar": 7,
    "brackets in text": {"s": '}{][" \\" {', "o": {"t": "[{"}},
}


def brute(value, path="$", parent="$", top=True):
    out = set()
    if isinstance(value, dict):
        if not top:
            out.add((path, parent))
        for k, v in value.items():
            out |= brute(v, f"{path}.{k}", path, False)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out |= brute(v, f"{path}[{i}]", parent, False)
    return out


def deep(n):
    return {"a": [deep(n - 1)]} if n else {}


def test_objects_match_recursion(spark):
    cases = NESTED | {"deep": deep(25)}
    rows = [(k, json.dumps(v)) for k, v in cases.items()]
    rows += [("twice", json.dumps(json.dumps(NESTED["plain"]))), ("thrice", json.dumps(json.dumps(json.dumps({"a": {}})))), ("often", json.dumps(json.dumps(json.dumps(json.dumps(json.dumps({"a": {"b": {}}})))))), ("cut", json.dumps(NESTED["plain"])[:-5]), ("none", None), ("blank", ""), ("words", "not json"), ("plain", json.dumps(NESTED["plain"]))]
    docs = nested.documents(spark.createDataFrame(rows, "key string, params string"), ["key"], "params")
    got = {(r.key, r.path, r.parent_path) for r in nested.objects(docs, ["key"]).filter("parent_path IS NOT NULL").collect()}
    want = {(k, *p) for k, v in (cases | {"twice": NESTED["plain"], "thrice": {"a": {}}, "often": {"a": {"b": {}}}}).items() for p in brute(v)}
    assert got == want
    assert nested.objects(docs.limit(0), ["key"]).count() == 0


def test_child_tables_keep_parents_and_ordinals(spark):
    v = {"who": {"list": [{"link": "l0", "score": 0.5}, {"link": 3}]}}
    docs = nested.documents(spark.createDataFrame([("k", json.dumps(v), "x")], "key string, params string, path string"), ["key"], "params")
    nodes = nested.objects(docs, ["key"])
    rows = nested.child_table(nodes, "t", F.col("key"), "$.who.list[]", {"link": "string", "score": "double"}).orderBy("ordinal").collect()
    parent = nodes.filter("path = '$.who'").select(nested.surrogate(F.lit("t"), F.col("key"), F.col("path"))).first()[0]
    assert [(r.parent_id, r.ordinal, r.link, r.score) for r in rows] == [(parent, 0, "l0", 0.5), (parent, 1, "3", None)]
    kinds = {(r.pattern, r.field, r.kind): r.n for r in nested.merged_schema(nodes).collect()}
    assert kinds[("$.who.list[]", "link", "STRING")] == 1 and kinds[("$", "who", "OBJECT")] == 1
