"""Streams run over what is there now, and sessions in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import jobs
from .registry import query


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_counts(spark, d):
    """Events by type and day, from a stream with a watermark."""
    s = jobs.collect_stream(jobs.tumbling_counts, spark, d, "events", "update", ["w", "event_type"])
    return s.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type")
def stream_change_only(spark, d):
    """Changes of each job's state, from a stream that keeps the last one."""
    out = ["user_id", "event_id", "event_type"]
    make = lambda e: jobs.changes(e, "user_id", ["ts", "event_id"], "event_type", out, "user_id long, event_id long, event_type string")
    return jobs.collect_stream(make, spark, d, "events", "append", [])


@query("""WITH e AS (SELECT user_id, event_type, count(*) FILTER (event_type = 'error') OVER w AS errors, count(*) FILTER (event_type = 'purchase') OVER w AS done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, CAST(least(coalesce(max(errors) FILTER (done = 0), 0), 5) AS INTEGER) AS tries, CASE WHEN coalesce(max(errors) FILTER (done = 0), 0) >= 5 THEN 'failed' WHEN max(done) > 0 THEN 'done' ELSE 'running' END AS status FROM e GROUP BY user_id""")
def stream_retries(spark, d):
    """Tries and status of each job, from a stream that keeps both."""
    return jobs.collect_stream(jobs.retries, spark, d, "events", "update", ["user_id"])


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, d):
    """Sessions that end after six hours without an event."""
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("started"), "n")
