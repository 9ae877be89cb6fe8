"""Joins and set operations between items, documents, assets and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import reciprocal_rank


def with_documents(items: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Items with their documents; orphans vanish."""
    return items.join(documents, key)


def without_orphans(items: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Items whose document exists; items without a document's key stay."""
    return items.filter(F.col(key).isNull()).unionByName(items.join(documents.select(key).distinct(), key, "left_semi"))


def split_links(links: DataFrame, assets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Links with an asset, and links without."""
    known = assets.select(key).distinct()
    return links.join(known, key, "left_semi"), links.join(known, key, "left_anti")


def in_listed_order(lists: DataFrame, rows: DataFrame, ids: str, key: str) -> DataFrame:
    """Rows of every list of identifiers, with their place in it; unknown identifiers are left out."""
    return lists.select(*[c for c in lists.columns if c != ids], F.posexplode(ids).alias("pos", key)).join(rows, key)


def fused(lists: DataFrame, keys: list[str], item: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rows (keys, item, channel, rank): the sum over all lists that hold the item."""
    return lists.groupBy(*keys, item).agg(F.sum(reciprocal_rank(F.col("rank"), k)).alias("score"), F.min(F.struct("channel", "rank")).alias("seen"))


def normalised_union(first: DataFrame, more: DataFrame, text: str, most: int = 60) -> DataFrame:
    """Rows of first, and those of more whose text without blanks (its first `most` characters) is not there yet; one of each."""
    from ..functions.text import without_blanks

    key = F.substring(without_blanks(F.col(text)), 1, most)
    a, b = first.withColumn("_key", key).dropDuplicates(["_key"]), more.withColumn("_key", key).dropDuplicates(["_key"])
    return a.unionByName(b.join(a.select("_key"), "_key", "left_anti")).drop("_key")


def worst(rows: DataFrame, keys: list[str], status: str, order: list[str], none: str) -> DataFrame:
    """The status that stands first in a fixed order of severity; none where all are null or unknown."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(status))
    return rows.groupBy(*keys).agg(F.coalesce(F.min_by(F.col(status), F.when(place > 0, place)), F.lit(none)).alias(status))
