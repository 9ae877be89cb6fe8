"""Call telemetry: totals, groups, days, order statistics, runs and retention."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import nearest_rank


def filtered(calls: DataFrame, since: str | datetime | None = None, project=None, run=None) -> DataFrame:
    """Conditions that are given, and no others; all of them reach the scan."""
    for column, value in (("project_id", project), ("run_id", run)):
        if value is not None:
            calls = calls.filter(F.col(column) == F.lit(value))
    return calls if since is None else calls.filter(F.col("created_at") >= F.lit(since))


def since_days(days: int, today: date) -> datetime:
    """Midnight of the first of the last `days` days, today among them."""
    first = today - timedelta(days=max(1, days) - 1)
    return datetime(first.year, first.month, first.day)


def measures() -> list[Column]:
    """Counts and null-skipping sums; unknown usage is counted, not estimated; the mean is cut to a whole number."""
    return [
        F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.count_if(F.col("total_tokens").isNull()).alias("calls_without_usage"), F.coalesce(F.avg("latency_ms").cast("long"), F.lit(0)).alias("avg_latency_ms"),
    ]


def totals(calls: DataFrame) -> DataFrame:
    return calls.agg(*measures())


def grouped(calls: DataFrame, key: str) -> DataFrame:
    return calls.groupBy(key).agg(*measures())


def by_sets(calls: DataFrame) -> DataFrame:
    """Totals, by purpose, by status and by day in one pass: level says which key a row has."""
    calls = calls.withColumn("day", F.to_date("created_at"))
    sets = [[], [F.col("purpose")], [F.col("status")], [F.col("day")]]
    rows = calls.groupingSets(sets, "purpose", "status", "day").agg(F.grouping_id().alias("gid"), *measures())
    level = F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, "purpose").when(F.col("gid") == 5, "status").otherwise("day")
    return rows.select(level.alias("level"), F.coalesce("purpose", "status", F.col("day").cast("string"), F.lit("")).alias("key"), "calls", "errors", "total_tokens", "calls_without_usage", "avg_latency_ms")


def by_day(calls: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """Calls and tokens of every day from first to last (default: of the data), days without calls too."""
    days = calls.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))
    bounds = days.agg(F.coalesce(F.lit(first), F.min("day")).alias("a"), F.coalesce(F.lit(last), F.max("day")).alias("b")).filter("a <= b")
    spine = bounds.select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days, "day", "left").select("day", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"))


def p95(calls: DataFrame, *keys: str) -> DataFrame:
    return nearest_rank(calls, list(keys), "latency_ms", 0.95)


def by_run(calls: DataFrame, tasks: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Runs, those with the newest call first; with the task's title and status where it is still known."""
    runs = calls.filter(F.col("run_id").isNotNull() & (F.col("run_id").cast("string") != "")).groupBy("run_id").agg(
        *measures(), F.sum("latency_ms").alias("latency_ms"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.max("call_id").alias("last_call")
    )
    runs = runs.orderBy(F.desc("last_call"), "run_id").limit(most) if most is not None else runs
    if tasks is None:
        return runs
    return runs.join(tasks, "run_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "task_status")})


def recent(calls: DataFrame, most: int = 30) -> DataFrame:
    return calls.orderBy(F.desc("call_id")).limit(most)


def pruned(calls: DataFrame, keep_days: int, now: datetime) -> DataFrame:
    return calls.filter(F.col("created_at") >= F.lit(now - timedelta(days=keep_days)))


def call_status(aborted: Column, error: Column, finish: Column, content: Column) -> Column:
    """One status of a call; an abort outranks an error, that a cut answer, that an empty one."""
    blank = F.trim(F.coalesce(content, F.lit(""))) == ""
    return F.when(F.coalesce(aborted, F.lit(False)), "aborted").when(F.coalesce(error, F.lit("")) != "", "error").when(F.coalesce(finish, F.lit("")) == "length", "truncated").when(blank, "empty").otherwise("ok")


def usage_fields(usage: Column) -> Column:
    """Token counts of a usage record in JSON, null where they are not given; cached tokens have two spellings."""
    at = lambda p: F.get_json_object(usage, p).try_cast("long")
    return F.struct(
        at("$.prompt_tokens").alias("prompt"), at("$.completion_tokens").alias("completion"), at("$.total_tokens").alias("total"),
        at("$.completion_tokens_details.reasoning_tokens").alias("reasoning"), F.coalesce(at("$.prompt_tokens_details.cached_tokens"), at("$.prompt_cache_hit_tokens")).alias("cached"),
    )


def over_budget(calls: DataFrame, most_calls: int, most_seconds: float) -> DataFrame:
    """Calls with their number in the run and whether the run's budget (calls or seconds since its first call) was used up before them."""
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy("created_at", "call_id")
    number = F.row_number().over(order)
    seconds = F.timestamp_diff("MILLISECOND", F.first("created_at").over(order), F.col("created_at")) / 1000
    return calls.select("call_id", "run_id", number.alias("number"), ((number > most_calls) | (seconds >= most_seconds)).alias("refused"))
