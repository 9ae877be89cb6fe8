"""The driver's parquet tables, and the entities that stand on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call records on `events`: one row per call, with the token count from the JSON column (null where it is not given)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("purpose"), F.col("user_id").alias("run_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("total_tokens"),
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of `documents`: doc_id, pos (from 0), line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "line"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section versions on `conversations`: section_id, version, source, content."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("section_id"), F.col("turn").alias("version"), F.col("role").alias("source"), F.col("text").alias("content"))
