"""Queries that run as streams over the event table, to their end, and return what they have written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from ..streaming import events as ev


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    at = scratch_path(spark, "stream")
    ev.drain(stream, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, since the table may be a file or a folder; one batch, since its files are in no order of time.
    return ev.read_stream(spark, f"{sf_dir}/events.parque[t]", files_per_trigger=None)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hourly windows: those that end before the watermark, the latest event less ten minutes."""
    out = ev.tumbling(_events(spark, sf_dir), "ts", "1 hour", "10 minutes", ["event_type"], F.count("*").alias("n"))
    return _run(spark, out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of users, with gaps of less than a day."""
    out = ev.sessions(_events(spark, sf_dir), "ts", "1 day", "10 minutes", ["user_id"], F.count("*").alias("n"))
    return _run(spark, out).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and type of event (all events lie within the watermark)."""
    out = ev.first_seen(_events(spark, sf_dir), "ts", "3650 days", ["user_id", "event_type"])
    return _run(spark, out.select("user_id", "event_type", "ts")).select("user_id", "event_type")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows of two hours, one beginning with each hour."""
    out = ev.sliding(_events(spark, sf_dir), "ts", "2 hours", "1 hour", "10 minutes", ["event_type"], F.count("*").alias("n"))
    return _run(spark, out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES = {"stream_tumbling": stream_tumbling, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions, "stream_first_seen": stream_first_seen}
ORACLE_SQL = {
    "stream_tumbling": "SELECT * FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "stream_sliding": "SELECT * FROM (SELECT h::TIMESTAMP AS start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(k) AS h, event_type FROM events, (VALUES (0), (1)) AS s(k)) GROUP BY 1, 2) WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "stream_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 1 DAY)::TIMESTAMP AS end, count(*) AS n FROM s GROUP BY user_id, s.n
HAVING max(ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
}
