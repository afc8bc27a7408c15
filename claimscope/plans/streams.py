"""Queries that run as streams over the event table until all of it is read, and writes by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.session import shared_dir
from claimscope.sources import sinks
from claimscope.streaming import ingest
from claimscope.tables import load

QUERIES, SQL = {}, {}


def query(body: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = body
        return f

    return add


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The event table as a stream of its files; every event is delivered twice."""
    e = s.readStream.schema(load(s, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events*.parquet")
    return e.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")


def _drained(out: DataFrame) -> DataFrame:
    """What a stream yields until its source is read, from the shared folder."""
    s, base = out.sparkSession, f"{shared_dir(out.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows")
    q.awaitTermination()
    return s.read.schema(out.schema).parquet(f"{base}/rows")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_once(s: SparkSession, d: str) -> DataFrame:
    """Each event once, however often it is delivered."""
    return _drained(ingest.once(_stream(s, d).select("event_id", "user_id", "event_type"), "event_id"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 3")
def stream_completed(s: SparkSession, d: str) -> DataFrame:
    """Units (here users) that reach three assignments, told in the batch in which they do."""
    return _drained(ingest.completed_units(ingest.once(_stream(s, d).select("event_id", "user_id"), "event_id"), "user_id", 3))


@query("""SELECT event_id, CASE WHEN event_type = 'signup' AND value >= 5 THEN 'sampled' WHEN event_type = 'view' THEN 'sampled' WHEN event_type = 'click' THEN 'done' ELSE event_type END AS state FROM events WHERE NOT (event_type = 'signup' AND coalesce(value < 5, true))""")
def staged_states(s: SparkSession, d: str) -> DataFrame:
    """Rows moved through stages by their state; a stage may drop rows, unknown states stay."""
    run = ingest.staged([("signup", "validated", lambda x: x.filter("value >= 5")), ("view", "validated", lambda x: x), ("validated", "sampled", lambda x: x), ("click", "done", lambda x: x)])
    run(load(s, d, "events").select("event_id", "value", F.col("event_type").alias("state")), 0)
    return run.result.select("event_id", "state")


_STORED = """st AS (SELECT event_id AS id, 'new' AS state, event_type AS response FROM events WHERE event_type <> 'view'), nw AS (SELECT event_id AS id, 'done' AS state, CASE WHEN value > 40 THEN 'other' ELSE event_type END AS response FROM events WHERE event_type <> 'click'),
cl AS (SELECT nw.* FROM nw JOIN st USING (id) WHERE nw.response <> st.response)"""


def _upsert(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = load(s, d, "events")
    stored = e.filter("event_type <> 'view'").select(F.col("event_id").alias("id"), F.lit("new").alias("state"), F.col("event_type").alias("response"))
    new = e.filter("event_type <> 'click'").select(F.col("event_id").alias("id"), F.lit("done").alias("state"), F.when(F.col("value") > 40, "other").otherwise(F.col("event_type")).alias("response"))
    return sinks.upsert(stored, new, ["id"], ["state"], ["response"])


@query(f"WITH {_STORED} SELECT coalesce(st.id, nw.id) AS id, CASE WHEN st.id IS NULL THEN nw.state WHEN nw.id IS NULL OR nw.id IN (SELECT id FROM cl) THEN st.state ELSE nw.state END AS state, coalesce(st.response, nw.response) AS response FROM st FULL JOIN nw ON st.id = nw.id")
def upserted_assignments(s: SparkSession, d: str) -> DataFrame:
    """Assignments after an update by key: new ones added, states taken over, responses never changed."""
    return _upsert(s, d)[0]


@query(f"WITH {_STORED} SELECT id, response FROM cl")
def upsert_conflicts(s: SparkSession, d: str) -> DataFrame:
    """Updates that would change a stored response."""
    return _upsert(s, d)[1]
