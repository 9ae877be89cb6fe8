"""Keyed state over write events: sections that are written under conditions, and progress that is reported sparingly.

The same steps run over a stream (state in the store, per key) and over a table (rows of a key in order, one after another, in
sorted partitions, so that no key is held whole).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SECTION = "content string, status string, revision long, reviewed long"
WRITTEN = "write_id long, outcome string, status string, revision long, reviewed long, replaced string"
WRITE = ["at", "write_id", "content", "status", "version_source", "expect_content", "expected_revision", "expected_status"]


class Section(NamedTuple):
    """What is kept of a section; reviewed is the revision that was reviewed."""

    content: str = ""
    status: str = "pending"
    revision: int = 0
    reviewed: int | None = None


def given(value) -> bool:
    return not (value is None or value is pd.NA or value != value)


def write(section: Section, event) -> tuple[Section, tuple]:
    """The section after a write, and (write_id, outcome, status, revision, reviewed, replaced).

    A write that expects other content is skipped; one made for another revision or status is refused; both change nothing.
    New content raises the revision and takes back a review; the same content as completed leaves a review standing; nothing
    empty is reviewed. A write with a version_source hands on the content that it replaced, to be kept as a version.
    """
    outcome, replaced = "written", None
    if given(event.expect_content) and event.expect_content != section.content:
        outcome = "skipped"
    elif (given(event.expected_revision) and event.expected_revision != section.revision) or (given(event.expected_status) and event.expected_status != section.status):
        outcome = "refused"
    else:
        content, status = event.content if given(event.content) else "", event.status
        revision = section.revision + (content != section.content)
        if content != section.content and status == "reviewed":
            status = "completed" if content.strip() else "pending"
        elif content == section.content and (section.status, status) == ("reviewed", "completed") and section.reviewed == section.revision:
            status = "reviewed"
        if status == "reviewed" and not content.strip():
            status = "pending"
        replaced = section.content if given(event.version_source) else None
        section = Section(content, status, revision, revision if status == "reviewed" else None)
    return section, (int(event.write_id), outcome, section.status, section.revision, section.reviewed, replaced)


def told(key: str, rows: list[tuple]) -> pd.DataFrame:
    """Outcomes with their keys, as columns that may hold nulls."""
    names = [key, *[c.split()[0] for c in WRITTEN.split(", ")]]
    return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype="Int64" if n in ("revision", "reviewed", "write_id") else object) for k, n in enumerate(names)})


class SectionWrites(StatefulProcessor):
    """Writes of a section against its row of state."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle) -> None:
        self.state = handle.getValueState("section", SECTION)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        section, out = Section(*self.state.get()) if self.state.exists() else Section(), []
        for event in pd.concat(list(rows)).sort_values(["at", "write_id"]).itertuples():
            section, row = write(section, event)
            out.append((key[0], *row))
        self.state.update(tuple(section))
        yield told(self.key, out)

    def close(self) -> None:
        pass


def section_writes(events: DataFrame, key: str = "section_id") -> DataFrame:
    """(key, write_id, outcome, status, revision, reviewed, replaced) for each write event of a table or a stream.

    events: key, at, write_id, content, status, version_source, expect_content, expected_revision, expected_status; the last
    four may be null, which asks for nothing. Writes of a key apply in the order of (at, write_id): over a stream within each
    batch, over a table at large. Keys are not null.
    """
    kind = events.schema[key].dataType.simpleString()
    rows, schema = events.select(key, *WRITE), f"{key} {kind}, {WRITTEN}"
    if rows.isStreaming:
        for name, value in STATE_CONF.items():
            rows.sparkSession.conf.set(name, value)
        return rows.groupBy(key).transformWithStateInPandas(SectionWrites(key), schema, "Append", "None")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, section = None, Section()
        for batch in batches:
            out = []
            for own, event in zip(batch[key].tolist(), batch.itertuples(), strict=True):
                if own != current:
                    current, section = own, Section()
                section, row = write(section, event)
                out.append((own, *row))
            yield told(key, out)

    return rows.repartition(key).sortWithinPartitions(key, "at", "write_id").mapInPandas(run, schema)


class Throttle(StatefulProcessor):
    """Of the events of a key those that come long enough after the last one told; a timer forgets keys that have gone quiet."""

    def __init__(self, key: str, least_ms: int, idle_ms: int):
        self.key, self.least, self.idle = key, least_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, timer = self.state.get() if self.state.exists() else (None, None)
        out, newest = [], None
        for event in pd.concat(list(rows)).sort_values(["at_ms", "event_id"]).itertuples():
            newest = event.at_ms
            if last is None or (key[0] is not None and newest - last >= self.least):
                last = newest
                out.append((key[0], int(event.event_id)))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int(newest + self.idle)
        self.handle.registerTimer(timer)
        self.state.update((int(last), timer))
        yield pd.DataFrame(out, columns=[self.key, "event_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def throttled(events: DataFrame, key: str = "task_id", ts: str = "ts", seconds: float = 2.0, late: str = "10 minutes", idle: float = 3600.0) -> DataFrame:
    """(key, event_id): the first event of each key, and each that comes at least so long after the last one told.

    events: key, ts (an instant), event_id. Events without a key are of no known task: only the first of them (of a stream, to come)
    is told. An event without a time comes after those with one and is told only if its key has none of these; a stream passes it
    over. A stream keeps one small row a key and forgets keys without events for `idle` seconds of event time, after which the next
    event counts as a first one; a table is read in order, a key not held whole.
    """
    kind, least = events.schema[key].dataType.simpleString(), int(seconds * 1000)
    ids = events.schema["event_id"].dataType.simpleString()
    rows = events.select(key, F.col(ts).alias("ts"), F.unix_millis(ts).alias("at_ms"), "event_id")
    schema = f"{key} {kind}, event_id {ids}"
    if rows.isStreaming:
        for name, value in STATE_CONF.items():
            rows.sparkSession.conf.set(name, value)
        own = rows.filter(F.col("ts").isNotNull()).withWatermark("ts", late)
        return own.groupBy(key).transformWithStateInPandas(Throttle(key, least, int(idle * 1000)), schema, "Append", "EventTime")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            kept = []
            for k, (own, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if own != current or (last is not None and at is not None and at - last >= least):
                    current, last = own, at
                    kept.append(k)
            yield batch.select([key, "event_id"]).take(pa.array(kept, pa.int64()))

    order = [F.asc_nulls_last("at_ms"), F.asc_nulls_last("event_id")]
    rows = rows.select(key, "at_ms", "event_id")
    nameless = rows.filter(F.col(key).isNull()).orderBy(*order).limit(1).select(key, "event_id")
    return rows.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema).unionByName(nameless)
