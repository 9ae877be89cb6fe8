"""Batch twins of the stream operators over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import windows
from .registry import query

MEASURES = "count(*) AS n, sum(value) AS total, max(value) AS most"


def rounded(df):
    return df.withColumn("total", F.round("total", 4))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY ALL""")
def tumbling(spark, sf_dir):
    return rounded(windows.tumbling(table(spark, sf_dir, "events"), "1 hour", ["event_type"]))


@query("""WITH s AS (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS start, value FROM events)
SELECT start, start + INTERVAL 1 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM s GROUP BY ALL""")
def sliding(spark, sf_dir):
    return rounded(windows.sliding(table(spark, sf_dir, "events"), "1 hour", "15 minutes", []))


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS fresh FROM events),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM s GROUP BY user_id, k""")
def session(spark, sf_dir):
    return rounded(windows.sessions(table(spark, sf_dir, "events"), "6 hours", ["user_id"]))


@query("""SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) AS progress, count(*) AS n, bool_or(event_type = 'error') AS cancel, max(ts) AS updated_at FROM events GROUP BY user_id""")
def task_states(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "ts", "event_id", F.col("event_type").alias("status"), F.col("value").alias("progress"), (F.col("event_type") == "error").alias("cancel"))
    return windows.task_states(rows)


@query("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id, a.ts, b.ts AS then_ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 DAY
WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def followed(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return windows.followed(events.filter("event_type = 'click'"), events.filter("event_type = 'purchase'"), "user_id", "2 days")


@query("""SELECT min(event_id) AS event_id, count(*) AS n FROM events GROUP BY event_id""")
def applied_once(spark, sf_dir):
    """Each event given twice counts once."""
    events = table(spark, sf_dir, "events")
    return windows.once(events.unionByName(events), "event_id").groupBy("event_id").agg(F.count("*").alias("n"))


def token_events(events):
    """Token events on `events`: a user's events are the tokens of one call, clicks are empty ones, purchases carry usage and errors end it."""
    content = F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    usage = F.when(F.col("event_type") == "purchase", F.get_json_object("props", "$.k").cast("long"))
    return events.select(F.col("user_id").alias("call_id"), "ts", F.col("event_id").alias("seq"), content.alias("content"), usage.alias("usage"), F.when(F.col("event_type") == "error", F.lit("length")).alias("finish"))


@query("""SELECT user_id AS call_id, date_sub('millisecond', min(ts), min(ts) FILTER (event_type != 'click')) AS first_token_ms, date_sub('millisecond', min(ts), max(ts)) AS latency_ms,
arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) FILTER (event_type = 'purchase' AND json_extract_string(props, '$.k') IS NOT NULL) AS usage,
arg_max('length', (ts, event_id)) FILTER (event_type = 'error') AS finish FROM events GROUP BY user_id""")
def call_meter(spark, sf_dir):
    return windows.call_meter(token_events(table(spark, sf_dir, "events")))
