"""Items to verify: occurrences that overlap are one, placeholders take the identity of an asset, decisions may be stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import same_value
from .intervals import overlaps


def inherited(occurrences: DataFrame) -> DataFrame:
    """Rows (section_id, start, end, item_key, kind, asset_key, basis) in which a placeholder that overlaps occurrences of exactly one asset has become that asset's item."""
    assets = occurrences.filter("asset_key IS NOT NULL").select("section_id", F.col("start").alias("from"), F.col("end").alias("to"), F.struct("asset_key", "item_key", "basis", "kind").alias("_asset"))
    holes = occurrences.filter("kind = 'placeholder'").select("item_key", "section_id", "start", "end")
    met = overlaps(holes, assets, ["section_id"]).groupBy("item_key").agg(F.count_distinct("_asset.asset_key").alias("n"), F.min("_asset").alias("_asset"))
    rows = occurrences.join(met.filter("n = 1").select("item_key", "_asset"), "item_key", "left")
    take = (F.col("kind") == "placeholder") & F.col("_asset").isNotNull()
    return rows.select("section_id", "start", "end", *[F.when(take, F.col(f"_asset.{c}")).otherwise(F.col(c)).alias(c) for c in ("item_key", "kind", "asset_key", "basis")])


def merged(occurrences: DataFrame) -> DataFrame:
    """item_key, section_id, start, end: of each item and section, runs of overlapping occurrences as one."""
    along = Window.partitionBy("item_key", "section_id").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(reach, F.col("start")) <= F.col("start")).cast("int")).over(along)
    return occurrences.withColumn("_island", island).groupBy("item_key", "section_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def counts(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_distinct("item_key").alias("items"), F.count("*").alias("occurrences"))


def decided(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items (item_key, basis) with state: confirmed, stale (the basis has changed since) or open."""
    rows = items.join(decisions.select("item_key", F.col("basis").alias("_basis"), F.lit(True).alias("_made")), "item_key", "left")
    return rows.withColumn("state", F.when(F.col("_made").isNull(), "open").when(F.col("basis").eqNullSafe(F.col("_basis")), "confirmed").otherwise("stale")).drop("_basis", "_made")


def value_conflicts(values: DataFrame) -> DataFrame:
    """topic, dimension, scope, clusters (the first value of each): commitments without a fact that take several values in several sections.

    values: topic, dimension, scope, section_id, pos, value, number, approx. A value joins the first cluster whose first value
    it agrees with, in the order of sections and places. The distinct values of a topic are folded, not all its mentions.
    """
    first = F.min(F.struct("section_id", "pos")).alias("at")
    distinct = values.groupBy("topic", "dimension", "scope", "value", "number", "approx").agg(first)
    sections = values.groupBy("topic", "dimension", "scope").agg(F.count_distinct("section_id").alias("sections"))
    own = F.array_sort(F.collect_list(F.struct("at", "value", "number", "approx", "dimension"))).alias("own")
    rows = distinct.groupBy("topic", "dimension", "scope").agg(own)
    heads = F.aggregate("own", F.slice("own", 1, 0), lambda acc, v: F.when(F.exists(acc, lambda c: same_value(c, v)), acc).otherwise(F.concat(acc, F.array(v))))
    found = rows.select("topic", "dimension", "scope", F.transform(heads, lambda c: c["value"]).alias("clusters")).join(sections, ["topic", "dimension", "scope"])
    return found.filter((F.size("clusters") > 1) & (F.col("sections") > 1)).drop("sections")
