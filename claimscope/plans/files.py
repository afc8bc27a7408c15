"""Queries of file readers and of validation over texts of their own: the files' lines are the tables, the SQL holds what
must come out of them, derived by hand from the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.operators import validate
from claimscope.sources import kbfiles

QUERIES, SQL = {}, {}


def query(body: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = body
        return f

    return add


def _lines(s: SparkSession, text: str, file: str = "f") -> DataFrame:
    return s.createDataFrame([(file, i, line) for i, line in enumerate(text.split("\n"), 1)], "file string, line long, value string")


STATEMENTS = """D1:0-5	PER	"Alice"		1.0
D1:10-14	ORG	"Acme"		1.0
D1:20-26	TITLE	"clerk"		1.0
D1:30-34	GPE	"Oslo"		1.0
D1:50-54	DATE	"1999"		1.0
D1:0-5	PER	"Alice"		1.0
D1:0-5	ORG	"Alice"		1.0
D1:0-5	PER	"Alicia"		1.0

D1:0-5	link	"wiki:Alice"		0.5
D1:0-5	link	"wiki:Alice"		0.9
D1:0-5	link	"wiki:Bob"		0.9
D1:10-14	link	"NILX7"		0.9
D1:50-54	link	"1999-XX-XX"		0.9
D1:20-26	link	"gloss:clerk"		0.9
D1:30-34	link	"wiki:Oslo"		0.9
D1:0-5	canonical_mention	D1:0-5		1.0
D1:10-14	canonical_mention	D2:1-4		1.0
D1:0-5	per:top_member_employee_of	D1:10-14		0.7
D1:0-5	per:title	D1:20-26	D1:0-26	0.8
D1:0-5	per:spouse	D1:20-26	D1:0-26	0.8
D1:30-34	gpe:residents_of_city	D1:0-5	D1:0-34	0.6
D1:0-5	per:title	D1:40-44	D1:0-44	0.8
D1:0-5	per:knows	D1:10-14	D1:0-14	0.8
D1:0-5	per:spouse	D1:0-5	D1:0-5	0.8
D1:0-5	per:date_of_birth	D1:50-54	D2:0-9	0.8
D9:0-5	PER	"Out"		1.0
D1:10-14	per:title	D1:20-26	D1:0-26	0.8
a	b	c	d	e	f
no provenance	PER	x		1.0"""


def _clean(s: SparkSession) -> validate.Clean:
    docs = s.createDataFrame([("D1",), ("D2",)], "doc_id string")
    return validate.validate(kbfiles.statements(_lines(s, STATEMENTS)), docs)


def _at(c: str) -> Column:
    return F.format_string("%s:%d-%d", f"{c}.doc_id", f"{c}.lo", f"{c}.hi")


@query("SELECT * FROM (VALUES ('D1:0-5', 'PER', 'Alice'), ('D1:10-14', 'ORG', 'Acme'), ('D1:20-26', 'TITLE', 'clerk'), ('D1:30-34', 'GPE', 'Oslo'), ('D1:50-54', 'DATE', '1999')) t(mention, mention_type, gloss)")
def kb_mentions(s: SparkSession, d: str) -> DataFrame:
    """The first definition of each mention."""
    return _clean(s).mentions.select(_at("subject").alias("mention"), F.col("relation").alias("mention_type"), F.col("object").alias("gloss"))


@query("SELECT * FROM (VALUES ('D1:0-5', 'wiki:Alice', 0.9), ('D1:10-14', 'NILX7', 0.9), ('D1:20-26', 'gloss:clerk', 0.9), ('D1:30-34', 'wiki:Oslo', 0.9), ('D1:50-54', 'date:1999-XX-XX', 0.9)) t(mention, link_name, weight)")
def kb_links(s: SparkSession, d: str) -> DataFrame:
    """One link per mention: the first one, with the last weight stated for it; dates in a namespace of their own."""
    return _clean(s).links.select(_at("subject").alias("mention"), F.col("object").alias("link_name"), "weight")


@query("SELECT * FROM (VALUES ('D1:0-5', 'D1:0-5', 1.0), ('D1:10-14', 'D1:10-14', 0.0), ('D1:20-26', 'D1:20-26', 0.0), ('D1:30-34', 'D1:30-34', 0.0), ('D1:50-54', 'D1:50-54', 0.0)) t(mention, canonical, weight)")
def kb_canonical(s: SparkSession, d: str) -> DataFrame:
    """One canonical mention each, by default the mention itself."""
    return _clean(s).canonical.select(_at("subject").alias("mention"), _at("object_prov").alias("canonical"), "weight")


@query("""SELECT * FROM (VALUES ('D1:0-5', 'per:employee_or_member_of', 'D1:10-14', 'D1:0-14', 0.7), ('D1:10-14', 'org:employees_or_members', 'D1:0-5', 'D1:0-14', 0.7), ('D1:0-5', 'per:title', 'D1:20-26', 'D1:0-26', 0.8),
 ('D1:0-5', 'per:place_of_residence', 'D1:30-34', 'D1:0-34', 0.6), ('D1:30-34', 'gpe:residents_in_place', 'D1:0-5', 'D1:0-34', 0.6)) t(subject, relation, object, provenances, weight)""")
def kb_relations(s: SparkSession, d: str) -> DataFrame:
    """Relations with known arguments of admitted types, in both directions."""
    provs = F.array_join(F.transform("provenances", lambda p: F.format_string("%s:%d-%d", p.doc_id, p.lo, p.hi)), ",")
    return _clean(s).relations.select(_at("subject").alias("subject"), "relation", _at("object_prov").alias("object"), provs.alias("provenances"), "weight")


@query("""SELECT * FROM (VALUES ('E01', 'error', 29), ('E02', 'error', 30), ('E03', 'error', 25), ('E04', 'error', 28), ('E11', 'error', 7), ('E12', 'error', 8), ('E14', 'error', 12), ('E15', 'error', 21), ('E22', 'error', 23), ('I31', 'info', 27), ('I32', 'info', 24),
 ('W06', 'warning', 18), ('W07', 'warning', 26), ('W08', 'warning', 13), ('W09', 'warning', 6), ('W25', 'warning', 19), ('W27', 'warning', 2), ('W27', 'warning', 3), ('W27', 'warning', 4), ('W27', 'warning', 5), ('W28', 'warning', 19), ('W28', 'warning', 22)) t(code, level, line)""")
def kb_issues(s: SparkSession, d: str) -> DataFrame:
    """What validation found, by line of the file."""
    return _clean(s).issues.select("code", "level", F.col("line").cast("int").alias("line")).distinct()


ENTITIES = """header
:e1	type	PER
:e1	mention	"Al"	D1:0-1	1
:e1	canonical_mention	"Al"	D1:0-1
:e2	type	ORG
:e2	mention	"Ac"	D1:10-11
:e2	mention	"Al"	D1:0-1
:e3	mention	"no type"	D1:50-51
:e1	per:employee_or_member_of	:e2	D1:0-20	0.9
:e2	org:members	:e9	D1:0-20	0.9"""


def _entities(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    return validate.resolve_entities(kbfiles.entity_statements(_lines(s, ENTITIES)))


@query("SELECT * FROM (VALUES ('mention', 'D1:0-2', 'PER', 'Al', NULL), ('mention', 'D1:10-12', 'ORG', 'Ac', NULL), ('link', 'D1:0-2', 'link', ':e1', NULL), ('link', 'D1:10-12', 'link', ':e2', NULL), ('canonical', 'D1:0-2', 'canonical_mention', NULL, 'D1:0-2'), ('canonical', 'D1:10-12', 'canonical_mention', NULL, 'D1:10-12'), ('relation', 'D1:0-2', 'per:employee_or_member_of', NULL, 'D1:10-12')) t(kind, subject, relation, object, object_at)")
def entity_file_statements(s: SparkSession, d: str) -> DataFrame:
    """An entity-centric file as statements about mentions; ends are inclusive in the file."""
    return _entities(s)[0].select("kind", _at("subject").alias("subject"), "relation", "object", F.when(F.col("object_prov").isNotNull(), _at("object_prov")).alias("object_at"))


@query("SELECT * FROM (VALUES ('E11', 'error', 7), ('E21', 'error', 8), ('W26', 'warning', 10)) t(code, level, line)")
def entity_file_issues(s: SparkSession, d: str) -> DataFrame:
    return _entities(s)[1].select("code", "level", F.col("line").cast("int").alias("line"))


@query("SELECT * FROM (VALUES ('per:employee_or_member_of', 0, 10), ('org:employees_or_members', 10, 0)) t(relation, subject_lo, object_lo)")
def entity_file_relations(s: SparkSession, d: str) -> DataFrame:
    """The same file after the validation of statements."""
    return validate.validate(_entities(s)[0]).relations.select("relation", F.col("subject.lo").alias("subject_lo"), F.col("object_prov.lo").alias("object_lo"))


MAP = "L1 C1 x\nL2 C1\nL3 C3"
GOLD = "1\tC1:per:title\tD:0-3,D:5-9\tclerk\tD:1-2\tC\tC\t0:17\n2\tC9:per:title\tD:0-3\tx\tD:1-2\tC\tC\t0\n3\tC3:org:members\tD:0-3\tAcme\tD:1-2\tW\tW\t0"
GOLD_2016 = "1\tC1:per:title\tD:0-3\tclerk\tD:1-2\tC\tskipped\tC\t0:4"
RUN = "C3\tper:title\trun_1\tD:0-3\tclerk\tTITLE\tD:1-2\t0.25\nC7\tper:title\trun_1\tD:0-3\tclerk\tTITLE\tD:1-2\t0.5"


@query("SELECT * FROM (VALUES ('L2', 'C1'), ('L3', 'C3')) t(query_id, other_id)")
def query_map_file(s: SparkSession, d: str) -> DataFrame:
    return kbfiles.query_map(_lines(s, MAP))


def _shown(g: DataFrame) -> DataFrame:
    return g.select("query_id", "relation", F.size("relation_provenances").alias("n_provenances"), "slot_value", "slot_value_label", "relation_label", "eq")


@query("SELECT * FROM (VALUES ('L2', 'per:title', 2, 'clerk', 'C', 'C', 17), ('L3', 'org:members', 1, 'Acme', 'W', 'W', 0)) t(query_id, relation, n_provenances, slot_value, slot_value_label, relation_label, eq)")
def gold_file(s: SparkSession, d: str) -> DataFrame:
    return _shown(kbfiles.gold(_lines(s, GOLD), query_map_file(s, d)))


@query("SELECT 'L2' AS query_id, 'per:title' AS relation, 1 AS n_provenances, 'clerk' AS slot_value, 'C' AS slot_value_label, 'C' AS relation_label, 4 AS eq")
def gold_file_2016(s: SparkSession, d: str) -> DataFrame:
    """The variant with a column more."""
    return _shown(kbfiles.gold(_lines(s, GOLD_2016), query_map_file(s, d), with_extra_column=True))


@query("SELECT 'L3' AS query_id, 'run_1' AS run_id, 'per:title' AS relation, 'clerk' AS slot_value, 'TITLE' AS slot_type, 0.25 AS confidence")
def run_file(s: SparkSession, d: str) -> DataFrame:
    return kbfiles.run(_lines(s, RUN), query_map_file(s, d)).select("query_id", "run_id", "relation", "slot_value", "slot_type", "confidence")


DOCUMENTS = [
    kbfiles.PROLOG + '<DOC id="NYT_ENG_20130822.0209"><HEADLINE> A  big\nday </HEADLINE><TEXT>First line\nsecond</TEXT></DOC>\n',
    '<DOC id="X"><DATE_TIME>2014-05-06T07:08</DATE_TIME><TEXT>\nFirst line\nsecond</TEXT></DOC>',
    '<doc id="ENG_DF_1"><post author="a" datetime="2011-12-13T01:02:03">hi</post><post datetime="2012-01-01T01:02:03">ho</post></doc>',
]


@query("SELECT * FROM (VALUES ('NYT_ENG_20130822.0209', 'A big day', '2013-08-22', 101), ('X', 'First line', '2014-05-06', 88), ('ENG_DF_1', '', '2011-12-13', 128)) t(id, title, doc_date, doc_length)")
def xml_documents(s: SparkSession, d: str) -> DataFrame:
    return kbfiles.documents_from_xml(s.createDataFrame([(x,) for x in DOCUMENTS], "value string")).drop("doc_digest")


TOPICS = '<?xml version="1.0"?><queries><query id="Q1"><name>Alice B</name><docid>D1</docid><beg>3</beg><end>9</end><enttype>per</enttype><slot0>per:title</slot0></query><query id="Q2"><name>Acme</name><docid>D2</docid><beg>0</beg><end>3</end><enttype>org</enttype><slot0>org:members</slot0></query></queries>'


@query("SELECT * FROM (VALUES ('Q1', 'Alice B', 'PER', 'D1', 3, 10, 'per:title'), ('Q2', 'Acme', 'ORG', 'D2', 0, 4, 'org:members')) t(query_id, gloss, mention_type, doc_id, lo, hi, slot)")
def xml_queries(s: SparkSession, d: str) -> DataFrame:
    return kbfiles.queries_from_xml(s.createDataFrame([(TOPICS,)], "value string"))


def _answer(**fields: str) -> str:
    return '<?xml version="1.0"?><Form xmlns="x">' + "".join(f"<Answer><QuestionIdentifier>{k}</QuestionIdentifier><FreeText>{v}</FreeText></Answer>" for k, v in fields.items()) + "</Form>"


@query("""SELECT * FROM (VALUES ('a1', 'h1', 'w1', 90.5, 'fine', 'pending-extraction', '[{"relation":"per:title"}]'), ('a2', 'h1', 'w2', -1.0, NULL, 'error', '{}'), ('a3', 'h1', 'w3', 3.0, NULL, 'approved', '[]'), ('a4', 'h1', 'w4', 3.0, NULL, NULL, '[]')) t(assignment_id, hit_id, worker_id, worker_time, comments, state, response)""")
def answer_fields(s: SparkSession, d: str) -> DataFrame:
    """Assignments from outside: fields out of their XML, states, and what is malformed as an error."""
    rows = [
        ("a1", "h1", "w1", _answer(workerTime="90.5", comment="fine", response='[{"relation":"per:title"}]'), "Submitted"), ("a2", "h1", "w2", _answer(workerTime="9", comment="", response=""), "Submitted"),
        ("a3", "h1", "w3", _answer(workerTime="3", comment="", response="[]"), "Approved"), ("a4", "h1", "w4", _answer(workerTime="3", response="[]"), "Unheard of"),
    ]
    return kbfiles.assignments_from_xml(s.createDataFrame(rows, "assignment_id string, hit_id string, worker_id string, answer string, status string"))


@query("SELECT * FROM (VALUES ('one', 'h1', 'w1', 'a1', 'D1', '12', 3.0, 0.5), ('one', 'h2', 'w2', 'a2', 'D2', '', -1.0, -1.0), ('two', 'h3', 'w3', 'a3', NULL, NULL, -1.0, -1.0)) t(file, hit_id, worker_id, assignment_id, doc_id, time_taken, units, reward)")
def legacy_answer_files(s: SparkSession, d: str) -> DataFrame:
    one = "doc_id\tHITId\tworkerId\tassignmentId\ttimeTaken\tunits\treward\nD1\th1\tw1\ta1\t12\t3\t0.5\nD2\th2\tw2\ta2\t\t\t"
    two = "workerId\tHITId\tassignmentId\nw3\th3\ta3"
    return kbfiles.legacy_answers(_lines(s, one, "one").unionByName(_lines(s, two, "two"))).drop("line")
