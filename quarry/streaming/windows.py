"""Event-time windows and keyed folds that read the same on a batch table and on a stream.

On a stream rows later than `late` are dropped and finished windows leave the state; on a batch table the watermark does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def local_time(events: DataFrame, ts: str) -> bool:
    """Whether event time has no zone; it is then read as UTC, whatever the session's zone, for watermarks need instants."""
    return events.schema[ts].dataType.typeName() == "timestamp_ntz"


def as_instant(events: DataFrame, ts: str) -> DataFrame:
    return events.withColumn(ts, F.to_timestamp(F.concat(F.col(ts).cast("string"), F.lit("Z")))) if local_time(events, ts) else events


def as_local(rows: DataFrame, *columns: str) -> DataFrame:
    """Instants back as UTC times without a zone."""
    back = lambda c: F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, cast(unix_micros(`{c}`) / cast(1000000 as decimal(20, 0)) as decimal(18, 6)))")
    return rows.withColumns({c: back(c) for c in columns})


def windowed(events: DataFrame, window: Column, keys: list[str], ts: str = "ts", value: str = "value", late: str = LATE) -> DataFrame:
    rows = as_instant(events, ts).withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    rows = rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "most")
    return as_local(rows, "start", "end") if local_time(events, ts) else rows


def tumbling(events: DataFrame, length: str, keys: list[str], ts: str = "ts", **options) -> DataFrame:
    return windowed(events, F.window(ts, length), keys, ts, **options)


def sliding(events: DataFrame, length: str, step: str, keys: list[str], ts: str = "ts", **options) -> DataFrame:
    return windowed(events, F.window(ts, length, step), keys, ts, **options)


def sessions(events: DataFrame, gap: str, keys: list[str], ts: str = "ts", **options) -> DataFrame:
    """Runs of events of a key with less than `gap` between two; a session ends `gap` after its last event."""
    return windowed(events, F.session_window(ts, gap), keys, ts, **options)


def once(events: DataFrame, key: str, ts: str = "ts", late: str = LATE) -> DataFrame:
    """The first event of each key within the watermark: applying an event twice changes nothing."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    rows = as_instant(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return as_local(rows, ts).select(*events.columns) if local_time(events, ts) else rows


def followed(first: DataFrame, then: DataFrame, key: str, within: str, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Pairs of an event and one of the same key that comes after it, up to `within` later: an interval join of two tables or streams.

    Both sides have key, ts and event_id. On streams the watermarks of both bound what is kept.
    """
    a = as_instant(first, ts).select(F.col(key), F.col(ts).alias("ts"), F.col("event_id").alias("first_id")).withWatermark("ts", late)
    b = as_instant(then, ts).select(F.col(key).alias("_key"), F.col(ts).alias("then_ts"), F.col("event_id").alias("then_id")).withWatermark("then_ts", late)
    rows = a.join(b, (a[key] == b["_key"]) & (b["then_ts"] > a["ts"]) & (b["then_ts"] <= a["ts"] + F.expr(f"INTERVAL {within}"))).select(key, "first_id", "then_id", "ts", "then_ts")
    return as_local(rows, "ts", "then_ts") if local_time(first, ts) else rows


def task_states(events: DataFrame, key: str = "task_id") -> DataFrame:
    """Per task the newest state, how many events it had and whether it was ever asked to stop; state is one small row a task."""
    newest = F.max_by(F.struct("status", "progress"), F.struct("ts", "event_id"))
    rows = events.groupBy(key).agg(newest.alias("now"), F.count("*").alias("n"), F.bool_or("cancel").alias("cancel"), F.max("ts").alias("updated_at"))
    return rows.select(key, "now.status", "now.progress", "n", "cancel", "updated_at")


def call_meter(tokens: DataFrame) -> DataFrame:
    """Per call the time to its first token, the last usage and finish reason, from a stream of token events."""
    first = F.min(F.when(F.col("content") != "", F.col("ts")))
    rows = tokens.groupBy("call_id").agg(
        F.min("ts").alias("started"), first.alias("first"), F.max("ts").alias("ended"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.struct("ts", "seq"))).alias("usage"), F.max_by("finish", F.when(F.col("finish").isNotNull(), F.struct("ts", "seq"))).alias("finish"),
    )
    return rows.select("call_id", F.timestamp_diff("MILLISECOND", "started", "first").alias("first_token_ms"), F.timestamp_diff("MILLISECOND", "started", "ended").alias("latency_ms"), "usage", "finish")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what is there now and return the result table (kept in memory: for small results and tests)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
