"""Hierarchies given as rows (id, parent_id): closure, paths, roll-ups and most specific mappings.

A closure is reached by doubling: pairs that are up to 2^k levels apart are joined with each other, so a tree of depth d takes
about log2(d) joins, each written to the shared folder so that plans stay short and lost executors cost one round.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: spark.checkpoint.dir, or the checkpoint directory set on the context.

    Where neither is set, a session in one process (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance) for every node and each of its ancestors, itself at distance 0.

    A parent that is not a node ends a path. A cycle is an error: distances may not reach the number of nodes.
    """
    own = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    known = nodes.select(F.col("id").alias("ancestor"))
    edges = nodes.filter(F.col("parent_id").isNotNull()).select("id", F.col("parent_id").alias("ancestor"), F.lit(1).cast("long").alias("distance"))
    reach = cut(edges.join(known, "ancestor", "left_semi").select("id", "ancestor", "distance"), "closure")
    n, size = nodes.count(), 1
    while True:
        far = reach.filter(F.col("distance") == size).select("id", F.col("ancestor").alias("mid"), F.col("distance").alias("d"))
        more = cut(far.join(reach.withColumnRenamed("id", "mid"), "mid").select("id", "ancestor", (F.col("d") + F.col("distance")).alias("distance")), "closure")
        if more.isEmpty():
            return own.unionByName(reach)
        size *= 2
        if size > n:
            raise ValueError("the hierarchy has a cycle")
        reach = reach.unionByName(more)


def breadcrumbs(nodes: DataFrame, reach: DataFrame, title: str = "title", sep: str = " > ") -> DataFrame:
    """id and the titles from its root down to itself."""
    steps = reach.join(nodes.select(F.col("id").alias("ancestor"), F.col(title).alias("_title")), "ancestor")
    path = F.reverse(F.array_sort(F.collect_list(F.struct("distance", "_title"))))
    return steps.groupBy("id").agg(F.array_join(F.transform(path, lambda s: s["_title"]), sep).alias("path"))


def rolled_up(values: DataFrame, reach: DataFrame, value: str) -> DataFrame:
    """id and the sum of value over its subtree; summed by node first, so that only one row a node is joined."""
    each = values.groupBy("id").agg(F.sum(value).alias(value))
    return reach.join(each, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum(value).alias(value))


def most_specific(mapped: DataFrame, reach: DataFrame) -> DataFrame:
    """Rows (item_id, id) of mapped without those that have a descendant with the same item."""
    below = reach.filter("distance > 0").join(mapped, "id").select("item_id", F.col("ancestor").alias("id")).distinct()
    return mapped.join(below, ["item_id", "id"], "left_anti")


def unshared(mapped: DataFrame, reach: DataFrame) -> DataFrame:
    """Rows (item_id, id) whose item no node outside the node's own subtree and ancestors carries.

    Counted, not paired: carriers related to a node are its carrying descendants and ancestors and itself; the item is
    unshared if that makes all its carriers.
    """
    mapped = mapped.select("item_id", "id").distinct()
    pairs = reach.filter("distance > 0").join(mapped, "id").join(mapped.select("item_id", F.col("id").alias("ancestor")), ["item_id", "ancestor"])
    related = pairs.select("item_id", "id").unionByName(pairs.select("item_id", F.col("ancestor").alias("id"))).groupBy("item_id", "id").agg(F.count("*").alias("n"))
    carriers = mapped.groupBy("item_id").agg(F.count("*").alias("total"))
    joined = mapped.join(carriers, "item_id").join(related, ["item_id", "id"], "left")
    return joined.filter(F.coalesce("n", F.lit(0)) + 1 == F.col("total")).select("item_id", "id")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")
