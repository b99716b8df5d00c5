"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.registry import query
from tidemark.streaming.jobs import deduplicated, event_stream, finished, windowed_counts

_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


@query("stream_tumbling_counts", f"SELECT {_SECONDS} // 3600 * 3600 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(windowed_counts(event_stream(spark, sf_dir), "1 hour"), "tumbling", "complete").select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("dedupe_window", "SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_id) AS rn FROM events) x WHERE rn = 1")
def dedupe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(deduplicated(event_stream(spark, sf_dir), "event_id", "1 day"), "dedupe").select("event_id", "user_id", "event_type")


@query("watch_ledger", f"WITH g AS (SELECT user_id, {_SECONDS} AS t, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS opens, event_id FROM events), k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS opened, count(*) AS n FROM k GROUP BY user_id, k")
def watch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch windows: a user's events with gaps under six hours, as session windows."""
    sessions = event_stream(spark, sf_dir).withWatermark("ts", "0 seconds").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return finished(sessions, "watch", "complete").select("user_id", F.unix_seconds("first").alias("opened"), "n")
