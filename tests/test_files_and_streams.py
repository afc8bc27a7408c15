"""Readers, writers, validation and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from claimscope.operators import validate
from claimscope.sources import kbfiles, sinks
from claimscope.streaming import ingest

LINES = """D1:0-5	PER	"Alice"		1.0
D1:10-14	ORG	"Acme"		1.0
D1:20-26	TITLE	"clerk"		1.0
D1:30-34	GPE	"Oslo"		1.0
D1:0-5	PER	"Alice"		1.0
D1:0-5	ORG	"Alice"		1.0
D1:0-5	PER	"Alicia"		1.0

D1:0-5	link	"wiki:Alice"		0.5
D1:0-5	link	"wiki:Alice"		0.9
D1:0-5	link	"wiki:Bob"		0.9
D1:10-14	link	"NILX7"		0.9
D1:0-5	canonical_mention	D1:0-5		1.0
D1:10-14	canonical_mention	D2:1-4		1.0
D1:0-5	per:top_member_employee_of	D1:10-14		0.7
D1:0-5	per:title	D1:20-26	D1:0-26	0.8
D1:0-5	per:spouse	D1:20-26	D1:0-26	0.8
D1:30-34	gpe:residents_of_city	D1:0-5	D1:0-34	0.6
D1:0-5	per:title	D1:40-44	D1:0-44	0.8
D1:0-5	per:knows	D1:10-14	D1:0-14	0.8
D9:0-5	PER	"Out"		1.0
D1:10-14	per:title	D1:20-26	D1:0-26	0.8
a	b	c	d	e	f
no provenance	PER	x		1.0
"""


@pytest.fixture
def statements(spark, tmp_path):
    (tmp_path / "kb.tsv").write_text(LINES)
    return kbfiles.read_statements(spark, str(tmp_path / "kb.tsv"))


def test_lines_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\n".join(f"line {i}" for i in range(1, 5001)))
    rows = kbfiles.numbered_lines(spark, str(tmp_path / "x.txt")).collect()
    assert len(rows) == 5000 and all(r.value == f"line {r.line}" for r in rows)


def test_validation(spark, statements):
    docs = spark.createDataFrame([("D1",), ("D2",)], "doc_id string")
    clean = validate.validate(statements, docs)
    spans = lambda df: {(r.subject.lo, r.relation, r.object_prov.lo) for r in df.collect()}
    assert {(r.subject.lo, r.relation, r.object) for r in clean.mentions.collect()} == {(0, "PER", "Alice"), (10, "ORG", "Acme"), (20, "TITLE", "clerk"), (30, "GPE", "Oslo")}
    assert {(r.subject.lo, r.object, r.weight) for r in clean.links.collect() if r.subject.lo in (0, 10)} == {(0, "wiki:Alice", 0.9), (10, "NILX7", 0.9)}
    assert {(r.subject.lo, r.object_prov.lo) for r in clean.canonical.collect()} == {(x, x) for x in (0, 10, 20, 30)}
    assert spans(clean.relations) == {(0, "per:employee_or_member_of", 10), (10, "org:employees_or_members", 0), (0, "per:title", 20), (0, "per:place_of_residence", 30), (30, "gpe:residents_in_place", 0)}
    cover = next(r for r in clean.relations.collect() if (r.subject.lo, r.object_prov.lo) == (0, 10))
    assert [tuple(p) for p in cover.provenances] == [("D1", 0, 14)]
    codes = {r.code for r in clean.issues.collect()}
    assert codes == {"E01", "E02", "E04", "E11", "E12", "E14", "E15", "E22", "I31", "I32", "W06", "W08", "W09", "W25", "W27", "W28", "W29"}


def test_statement_round_trip(spark, statements, tmp_path):
    clean = validate.validate(statements.filter("kind <> 'bad'"))
    lines = sinks.statement_lines(clean.mentions, clean.links, clean.canonical, clean.relations)
    sinks.write_statements(lines, str(tmp_path / "out"))
    again = validate.validate(kbfiles.read_statements(spark, str(tmp_path / "out")))
    key = lambda df: {(r.subject, r.relation, r.object_prov) for r in df.collect()}
    assert key(again.relations) == key(clean.relations)
    assert {r.code for r in again.issues.collect()} <= {"W08"}


def test_entity_statements(spark, tmp_path):
    text = "header\n:e1\ttype\tPER\n:e1\tmention\t\"Al\"\tD1:0-1\t1\n:e1\tcanonical_mention\t\"Al\"\tD1:0-1\n:e2\ttype\tORG\n:e2\tmention\t\"Ac\"\tD1:10-11\n:e2\tmention\t\"Al\"\tD1:0-1\n:e3\tmention\t\"no type\"\tD1:50-51\n:e1\tper:employee_or_member_of\t:e2\tD1:0-20\t0.9\n:e2\torg:members\t:e9\tD1:0-20\t0.9\n"
    (tmp_path / "kb.tac").write_text(text)
    rows, issues = validate.resolve_entities(kbfiles.read_entity_statements(spark, str(tmp_path / "kb.tac")))
    clean = validate.validate(rows)
    assert {(r.subject.lo, r.subject.hi, r.object) for r in clean.mentions.collect()} == {(0, 2, "Al"), (10, 12, "Ac")}
    assert {(r.relation, r.object_prov.lo) for r in clean.relations.collect()} == {("per:employee_or_member_of", 10), ("org:employees_or_members", 0)}
    assert {r.code for r in issues.collect()} == {"E11", "E21", "W26"}


def test_gold_run_and_query_map(spark, tmp_path):
    (tmp_path / "q").write_text("L1 C1 x\nL2 C1\nL3 C3\n")
    (tmp_path / "g").write_text("1\tC1:per:title\tD:0-3,D:5-9\tclerk\tD:1-2\tC\tC\t0:17\n2\tC9:per:title\tD:0-3\tx\tD:1-2\tC\tC\t0\n")
    (tmp_path / "r").write_text("C3\tper:title\trun_1\tD:0-3\tclerk\tTITLE\tD:1-2\t0.25\n")
    q = kbfiles.read_query_map(spark, str(tmp_path / "q"))
    assert {(r.query_id, r.other_id) for r in q.collect()} == {("L2", "C1"), ("L3", "C3")}
    g = kbfiles.read_gold(spark, str(tmp_path / "g"), q).collect()
    assert len(g) == 1 and (g[0].query_id, g[0].relation, g[0].eq, len(g[0].relation_provenances)) == ("L2", "per:title", 17, 2)
    r = kbfiles.read_run(spark, str(tmp_path / "r"), q).collect()
    assert (r[0].query_id, r[0].confidence) == ("L3", 0.25)


def test_xml_documents(spark):
    xml = '<DOC id="NYT_ENG_20130822.0209"><HEADLINE> A  big\nday </HEADLINE><TEXT>First line\nsecond</TEXT></DOC>'
    other = '<DOC id="X"><DATE_TIME>2014-05-06T07:08</DATE_TIME><TEXT>First line\nsecond</TEXT></DOC>'
    rows = {r.id: r for r in kbfiles.documents_from_xml(spark.createDataFrame([(xml,), (other,)], "value string")).collect()}
    assert (rows["NYT_ENG_20130822.0209"].title, rows["NYT_ENG_20130822.0209"].doc_date) == ("A big day", "2013-08-22")
    assert (rows["X"].title, rows["X"].doc_date) == ("First line", "2014-05-06")


def test_replacing_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "submission_id int, v string")
    for _ in range(2):
        sinks.replace_partitions(df, str(tmp_path / "t"), "submission_id")
    sinks.replace_partitions(spark.createDataFrame([(2, "c")], "submission_id int, v string"), str(tmp_path / "t"), "submission_id")
    assert {(r.submission_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "c")}


def test_upsert_and_insert_missing(spark):
    old = spark.createDataFrame([(1, "new", "r1"), (2, "new", "r2")], "id int, state string, response string")
    new = spark.createDataFrame([(1, "done", "r1"), (2, "done", "other"), (3, "new", "r3")], "id int, state string, response string")
    merged, conflicts = sinks.upsert(old, new, ["id"], ["state"], ["response"])
    assert {tuple(r) for r in merged.collect()} == {(1, "done", "r1"), (2, "new", "r2"), (3, "new", "r3")}
    assert [tuple(r) for r in conflicts.collect()] == [(2, "other")]
    assert sinks.insert_missing(old, new, ["id"]).count() == 3


def put(folder, k: int, lines: list[str]) -> None:
    """A file of a stream; the source reads files in the order of their times, so these are set apart."""
    path = folder / f"{k}.json"
    path.write_text("\n".join(lines))
    os.utime(path, (1_600_000_000 + 60 * k, 1_600_000_000 + 60 * k))


def run_stream(spark, folder, schema, build, name, mode):
    q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))).writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_completion_stream_equals_batch(spark, tmp_path):
    rows = [{"assignment_id": f"a{i % 9}", "hit": f"h{(i % 9) % 3}"} for i in range(15)]
    for k in range(3):
        put(tmp_path, k, [json.dumps(r) for r in rows[5 * k : 5 * k + 5]])
    got = run_stream(spark, tmp_path, "assignment_id string, hit string", lambda s: ingest.completed_units(ingest.once(s), "hit", 3), "done_units", "append")
    assert sorted((r.hit, r.n >= 3) for r in got) == [("h0", True), ("h1", True), ("h2", True)]


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    # rows count as late against the watermark of the batch before, so one more batch lies between
    days = ["2016-01-01", "2016-01-02", "2016-01-10", "2016-01-11", "2016-01-01", "2016-01-20"]
    for k, d in enumerate(days):
        put(tmp_path, k, [json.dumps({"at": f"{d} 10:00:00", "kind": "x"})])
    got = run_stream(spark, tmp_path, "at timestamp, kind string", lambda s: ingest.windowed_counts(s, "at", "kind"), "windows", "append")
    assert sorted((str(r.start)[:10], r.n) for r in got) == [("2016-01-01", 1), ("2016-01-02", 1), ("2016-01-10", 1), ("2016-01-11", 1)]


def test_staged_batches(spark):
    run = ingest.staged([("uploaded", "validated", lambda d: d.filter("ok")), ("validated", "sampled", lambda d: d)])
    run(spark.createDataFrame([(1, True, "uploaded"), (2, False, "uploaded"), (3, True, "other"), (4, True, None)], "id int, ok boolean, state string"), 0)
    assert {(r.id, r.state) for r in run.result.collect()} == {(1, "sampled"), (3, "other"), (4, None)}
    assert run.result.agg(F.count(F.lit(1))).first()[0] == 3
