"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, stage


def least_neighbours(edges: DataFrame) -> DataFrame:
    """For each u the least of u and its neighbours v, and how many those are."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node of the component; edges has two long columns, u and v.

    Rounds go on until the edges are stars around the least nodes. Each round's edges are written to the shared folder. Minima are
    taken before the shuffle, and the edges of a node with very many neighbours stay where they are (see `join_by_key`).
    """
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    before, now = None, signature(edges)
    while now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_by_key(both, least_neighbours(both), ["u"], 2 * now[0], "degree").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = stage(large.filter("u > v"), "stars")
        low = least_neighbours(down)
        small = join_by_key(down, low, ["u"], down.count(), "degree").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = stage(small, "edges")
        before, now = now, signature(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
