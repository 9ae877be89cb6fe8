"""Telemetry queries over `events`."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import usage
from ..sources.tables import calls, table
from .registry import query

CALLS = """
WITH calls AS (SELECT event_id AS call_id, ts AS created_at, event_type AS purpose, user_id AS run_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
  value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_tokens FROM events)
"""
MEASURES = """count(*) AS calls, count(*) FILTER (status = 'error') AS errors, coalesce(CAST(sum(total_tokens) AS BIGINT), 0) AS total_tokens,
  count(*) FILTER (total_tokens IS NULL) AS calls_without_usage, coalesce(CAST(trunc(avg(latency_ms)) AS BIGINT), 0) AS avg_latency_ms"""


@query(f"{CALLS} SELECT {MEASURES} FROM calls WHERE created_at >= TIMESTAMP '2024-01-10'")
def usage_totals(spark, sf_dir):
    return usage.totals(usage.filtered(calls(spark, sf_dir), since=datetime(2024, 1, 10)))


@query(f"{CALLS} SELECT {MEASURES} FROM calls WHERE run_id = 7")
def usage_totals_of_run(spark, sf_dir):
    return usage.totals(usage.filtered(calls(spark, sf_dir), run=7))


@query(f"{CALLS} SELECT purpose, {MEASURES} FROM calls GROUP BY purpose")
def usage_by_purpose(spark, sf_dir):
    return usage.grouped(calls(spark, sf_dir), "purpose")


@query(f"{CALLS} SELECT status, count(*) AS calls FROM calls GROUP BY status")
def usage_by_status(spark, sf_dir):
    return usage.grouped(calls(spark, sf_dir), "status").select("status", "calls")


@query(f"""{CALLS}, d AS (SELECT *, CAST(created_at AS DATE) AS day FROM calls)
SELECT CASE grouping(purpose, status, day) WHEN 7 THEN 'all' WHEN 3 THEN 'purpose' WHEN 5 THEN 'status' ELSE 'day' END AS level,
  coalesce(purpose, status, CAST(day AS VARCHAR), '') AS key, {MEASURES}
FROM d GROUP BY GROUPING SETS ((), (purpose), (status), (day))""")
def usage_by_sets(spark, sf_dir):
    return usage.by_sets(calls(spark, sf_dir))


@query(f"""{CALLS}, days AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS calls, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens FROM calls GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, coalesce(calls, 0) AS calls, coalesce(total_tokens, 0) AS total_tokens FROM spine LEFT JOIN days USING (day)""")
def usage_by_day_filled(spark, sf_dir):
    return usage.by_day(calls(spark, sf_dir), date(2023, 12, 28), date(2024, 2, 3))


P95 = "row_number() OVER ({} ORDER BY latency_ms NULLS FIRST) AS rn, count(*) OVER ({}) AS n"


@query(f"{CALLS}, r AS (SELECT latency_ms, {P95.format('', '')} FROM calls) SELECT latency_ms FROM r WHERE rn = CAST(floor(CAST(0.95 AS DOUBLE) * (n - 1)) AS BIGINT) + 1")
def usage_p95(spark, sf_dir):
    return usage.p95(calls(spark, sf_dir))


@query(f"{CALLS}, r AS (SELECT purpose, latency_ms, {P95.format('PARTITION BY purpose', 'PARTITION BY purpose')} FROM calls) SELECT purpose, latency_ms FROM r WHERE rn = CAST(floor(CAST(0.95 AS DOUBLE) * (n - 1)) AS BIGINT) + 1")
def usage_p95_by_purpose(spark, sf_dir):
    return usage.p95(calls(spark, sf_dir), "purpose")


@query(f"""{CALLS}, runs AS (SELECT run_id, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  min(created_at) AS started_at, max(created_at) AS ended_at, max(call_id) AS last_call FROM calls GROUP BY run_id ORDER BY last_call DESC, run_id LIMIT 20)
SELECT runs.*, coalesce(c_name, '') AS title, coalesce(c_mktsegment, '') AS task_status FROM runs LEFT JOIN customer ON c_custkey = run_id""")
def usage_by_run(spark, sf_dir):
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("task_status"))
    return usage.by_run(calls(spark, sf_dir), tasks, most=20).select("run_id", "calls", "errors", "total_tokens", "started_at", "ended_at", "last_call", "title", "task_status")


@query(f"{CALLS} SELECT call_id, created_at, purpose, status, latency_ms, total_tokens FROM calls ORDER BY call_id DESC LIMIT 30")
def usage_recent(spark, sf_dir):
    return usage.recent(calls(spark, sf_dir)).select("call_id", "created_at", "purpose", "status", "latency_ms", "total_tokens")


@query(f"{CALLS} SELECT call_id, created_at FROM calls WHERE created_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 DAY")
def usage_retention(spark, sf_dir):
    return usage.pruned(calls(spark, sf_dir), 10, datetime(2024, 1, 30, 12)).select("call_id", "created_at")


@query("""SELECT event_id, CASE WHEN event_type = 'signup' THEN 'aborted' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'truncated' WHEN value < 1 THEN 'empty' ELSE 'ok' END AS status FROM events""")
def usage_call_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = usage.call_status(kind == "signup", F.when(kind == "error", kind), F.when(kind == "view", "length").otherwise("stop"), F.when(F.col("value") < 1, "").otherwise("text"))
    return rows.select("event_id", status.alias("status"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt, CAST(NULL AS BIGINT) AS total, CAST(NULL AS BIGINT) AS cached FROM events""")
def usage_fields(spark, sf_dir):
    record = F.regexp_replace("props", '"k"', '"prompt_tokens"')
    return table(spark, sf_dir, "events").select("event_id", usage.usage_fields(record).alias("u")).select("event_id", "u.prompt", "u.total", "u.cached")


@query("""WITH o AS (SELECT event_id AS call_id, user_id AS run_id, row_number() OVER w AS number, date_diff('millisecond', first_value(ts) OVER w, ts) / 1000.0 AS seconds
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT call_id, run_id, number, number > 15 OR seconds >= 864000 AS refused FROM o""")
def usage_budget(spark, sf_dir):
    return usage.over_budget(calls(spark, sf_dir), 15, 864000)
