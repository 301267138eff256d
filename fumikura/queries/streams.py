"""Streaming queries over ``events``.  The registered ones run the plan on the table as a batch; ``stream_*_live``
run it as a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fumikura.sources.corpus import table
from fumikura.streaming import counts as st


def _events(s, d):
    return st.timed(table(s, d, "events"))


def _live(s, d):
    schema = table(s, d, "events").schema
    return st.timed(s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


def stream_window_counts(s, d):
    return st.window_counts(_events(s, d), "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sliding_counts(s, d):
    return st.window_counts(_events(s, d), "event_type", size="1 day", slide="12 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sessions(s, d):
    return st.sessions(_events(s, d), "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_first_arrivals(s, d):
    e = st.first_arrivals(_events(s, d), "user_id", "event_type")
    return e.groupBy("event_type").agg(F.count("*").alias("users"))


def stream_window_counts_live(s, d):
    return st.run(st.window_counts(_live(s, d), "event_type"), "w" + uuid.uuid4().hex).withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (stream_window_counts, stream_sliding_counts, stream_sessions, stream_first_arrivals, stream_window_counts_live)}
_TUMBLE = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"
SQL = {
    "stream_window_counts": _TUMBLE,
    "stream_window_counts_live": _TUMBLE,
    "stream_sliding_counts": "WITH h AS (SELECT *, date_trunc('day', ts) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END AS half FROM events WHERE ts IS NOT NULL), e AS (SELECT half AS start, event_type, value FROM h UNION ALL SELECT half - INTERVAL 12 HOUR, event_type, value FROM h) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, no",
    "stream_first_arrivals": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
}
