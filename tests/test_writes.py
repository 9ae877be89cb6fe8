"""Writes of sections under conditions, and progress told sparingly: table, stream and stream after a restart agree."""

import datetime
import random

import duckdb
from pyspark.sql import functions as F

from quarry import plans
from quarry.streaming import writes

EVENT = "section_id long, at long, write_id long, content string, status string, version_source string, expect_content string, expected_revision long, expected_status string"


def events(seed, n):
    rng = random.Random(seed)
    return [
        (rng.randrange(8), i, i, rng.choice(["a", "b", "", " ", None]), rng.choice(["reviewed", "completed", "pending"]), rng.choice([None, "polish"]), rng.choice([None, None, None, "a"]), rng.choice([None, None, 0, 1, 2, 3]), rng.choice([None, None, None, "reviewed", "completed"]))
        for i in range(n)
    ]


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rules(spark):
    """New content raises the revision and takes back the review; the same content leaves it; stale writes change nothing."""
    rows = [
        (1, 1, 1, "text", "completed", None, None, 0, None), (1, 2, 2, "text", "reviewed", None, None, None, None), (1, 3, 3, "text", "completed", None, None, None, None),
        (1, 4, 4, "new", "reviewed", "polish", None, 1, "reviewed"), (1, 5, 5, "late", "completed", "batch", None, 1, None), (1, 6, 6, "late", "completed", "batch", "text", None, None), (1, 7, 7, "", "reviewed", None, "new", None, None),
    ]
    found = [tuple(r)[1:] for r in writes.section_writes(spark.createDataFrame(rows, EVENT)).orderBy("write_id").collect()]
    assert found == [
        (1, "written", "completed", 1, None, None), (2, "written", "reviewed", 1, 1, None), (3, "written", "reviewed", 1, 1, None), (4, "written", "completed", 2, None, "text"),
        (5, "refused", "completed", 2, None, None), (6, "skipped", "completed", 2, None, None), (7, "written", "pending", 3, None, None),
    ]
    assert writes.section_writes(spark.createDataFrame([], EVENT)).count() == 0


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, target, checkpoint):
    df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_table_after_a_restart(spark, tmp_path):
    rows = events(3, 300)
    table = spark.createDataFrame(rows, EVENT)
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in (rows[:100], rows[100:200]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(folder)
        drain(writes.section_writes(stream_of(spark, folder, EVENT)), target, checkpoint)  # ends, and is started anew from its state
    spark.createDataFrame(rows[200:], EVENT).coalesce(1).write.mode("append").parquet(folder)
    drain(writes.section_writes(stream_of(spark, folder, EVENT)), target, checkpoint)
    key = lambda r: [(x is not None, x) for x in r]
    found, wanted = (sorted((tuple(r) for r in df.collect()), key=key) for df in (spark.read.parquet(target), writes.section_writes(table)))
    assert found == wanted and len(found) == 300 and {r[2] for r in found} == {"written", "refused", "skipped"}


def test_throttled(spark, tmp_path):
    rng = random.Random(4)
    start, at, rows = datetime.datetime(2024, 1, 1), 0.0, []
    for i in range(200):
        at += rng.choice([0.1, 0.5, 1.0, 3.0])
        rows.append((i % 3, start + datetime.timedelta(seconds=at), i))
    schema = "task_id long, ts timestamp, event_id long"
    last, wanted = {}, []
    for task, ts, i in rows:
        if task not in last or (ts - last[task]).total_seconds() >= 2:
            last[task] = ts
            wanted.append((task, i))
    table = spark.createDataFrame(rows, schema)
    assert as_rows(writes.throttled(table)) == sorted(wanted)
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in (rows[:80], rows[80:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        drain(writes.throttled(stream_of(spark, folder, schema)), target, checkpoint)
    assert as_rows(spark.read.parquet(target).select("task_id", "event_id")) == sorted(wanted)


def test_quiet_keys_are_forgotten(spark, tmp_path):
    """A timer clears the state of a key that has had no event for a while."""
    schema = "task_id long, ts timestamp, event_id long"
    start = datetime.datetime(2024, 1, 1)
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for i, minutes in enumerate((0, 600, 1200)):
        spark.createDataFrame([(i, start + datetime.timedelta(minutes=minutes), i)], schema).coalesce(1).write.mode("append").parquet(folder)
        drain(writes.throttled(stream_of(spark, folder, schema)), target, checkpoint)
    state = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    assert 0 not in [r[0] for r in state.select(F.col("key.task_id")).collect()]
    assert spark.read.parquet(target).count() == 3


def test_throttled_without_task_or_time(spark, tmp_path):
    """Nulls fall as in the query's SQL: of events without a task one is told, events without a time come last, ids stay whole."""
    start, big = datetime.datetime(2024, 1, 1), (1 << 60) + 1
    hours = [(None, 40, 1), (None, 0, 2), (None, 20, 3), (None, None, 4), (1, None, 5), (1, 0, None), (1, 0, 6), (1, 9, 7), (1, 10, 8), (2, None, 10), (2, None, 9), (big, 0, big), (big + 1, 0, big + 1), (big, 30, big + 2)]
    rows = [(user, None if h is None else start + datetime.timedelta(hours=h), event) for user, h, event in hours]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long")
    events.write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    wanted = db.execute(plans.SQL["throttled_progress"]).fetchall()
    found = [tuple(r) for r in plans.QUERIES["throttled_progress"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str) == sorted([(None, 2), (1, 6), (1, 8), (2, 9), (big, big), (big + 1, big + 1), (big, big + 2)], key=str)
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "user_id long, ts timestamp, event_id long"
    spark.createDataFrame(events.filter("event_id IS NOT NULL").collect(), schema).coalesce(1).write.parquet(folder)
    drain(writes.throttled(stream_of(spark, folder, schema), "user_id", seconds=36_000), target, checkpoint)
    told = [tuple(r) for r in spark.read.parquet(target).collect()]
    assert sorted(r for r in told if r[0]) == sorted(r for r in wanted if r[0] not in (None, 2)) and [r[0] for r in told].count(None) == 1
