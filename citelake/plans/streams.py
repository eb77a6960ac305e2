"""Streaming queries, run to the end of the given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.plans.tables import table
from citelake.registry import register
from citelake.streaming import events as streams


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return streams.read_events(spark, sf_dir, "events.parquet", schema)


@register("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_window_counts(spark, sf_dir):
    counts = streams.window_counts(_stream(spark, sf_dir), "ts", "event_type")
    done = streams.run_to_end(counts, "complete", "windows")
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(
    """
    WITH m AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM m)
    SELECT user_id, min(ts) AS begin, max(ts) AS "end", count(*) AS checks FROM s GROUP BY user_id, g"""
)
def stream_sessions(spark, sf_dir):
    sessions = streams.session_counts(_stream(spark, sf_dir), "ts", "user_id", late=None)
    done = streams.run_to_end(sessions, "complete", "sessions")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begin", "end")})


@register("""SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def stream_running_totals(spark, sf_dir):
    totals = streams.running_totals(_stream(spark, sf_dir), "event_type", "value")
    return streams.run_to_end(totals, "complete", "totals").withColumn("total", F.round("total", 2))


@register("""SELECT event_id, event_type FROM events""")
def stream_deduplicated(spark, sf_dir):
    rows = streams.deduplicated(_stream(spark, sf_dir), "ts", ["event_id"], late=None)
    return streams.run_to_end(rows.select("event_id", "event_type"), "append", "distinct")
