"""Order statistics, latest rows and running picks that hold for keys with very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of the value range in which ranks are counted before rows are ordered.
STRETCHES = 128


def nearest_rank(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """keys and the value at the zero-based place int(share * (n - 1)) of each key's ascending values; nulls come first.

    A key is never sorted whole. Approximate quantiles cut its values into stretches; counts by stretch tell where the place
    lies; only the values of that stretch are counted one by one and ordered. Keys may be empty: the whole table is one key,
    and an empty table gives one null.
    """
    rows = rows.select(*keys, F.col(value).alias("v"))
    marks = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", [i / STRETCHES for i in range(1, STRETCHES)], 1000).alias("marks"))
    marks = marks.withColumn("place", F.floor(F.lit(share) * (F.col("n") - 1)))
    marks = marks.withColumn("marks", F.coalesce(F.array_sort(F.array_distinct("marks")), F.array().cast(marks.schema["marks"].dataType)))
    cut = F.when(F.col("v").isNull(), -1).otherwise(F.size(F.filter("marks", lambda m: m < F.col("v"))))
    if keys:
        cutting = rows.join(marks.select(*keys, "marks"), keys)
    else:
        cutting = rows.join(F.broadcast(marks.select("marks")))  # one row
    counted = cutting.withColumn("stretch", cut).groupBy(*keys, "stretch", "v").agg(F.count("*").alias("c"))
    stretches = counted.groupBy(*keys, "stretch").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("stretch"))
    stretches = stretches.withColumn("before", upto - F.col("c"))
    places = marks.select(*keys, "place")
    stretches = stretches.join(places, keys) if keys else stretches.join(F.broadcast(places))
    found = stretches.filter((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("c"))).select(*keys, "stretch", "before", "place")
    inside = counted.join(found, [*keys, "stretch"])
    last = F.col("before") + F.sum("c").over(Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()))
    return inside.withColumn("last", last).filter(F.col("last") > F.col("place")).groupBy(*keys).agg(F.min_by("v", "last").alias(value))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the greatest order values of each key; combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("row"))
    return picked.select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in others])


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], most: int, rank: str = "rank") -> DataFrame:
    """The first `most` rows of each key, numbered from 1; Spark drops rows beyond that rank before the shuffle."""
    numbered = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(rank) <= most)


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Each distinct value of a key with its first place."""
    return rows.groupBy(*keys, value).agg(F.min(pos).alias(pos))
