"""Joins of intervals that overlap, without pairing all intervals of a key.

Each interval is put into the bins of the smallest level at which it touches two bins at most (bins are 16 times as wide from
level to level), and meets others only in bins of its own level or of theirs, whichever is higher.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits by which bins grow from level to level, and the highest level.
STEP, TOP = 4, 14


def bin_of(place: Column, level: Column) -> Column:
    return F.floor(place / F.pow(F.lit(2.0), level * STEP)).cast("long")


def own_level(start: Column, end: Column) -> Column:
    out = F.lit(TOP)
    for level in range(TOP - 1, -1, -1):
        out = F.when(bin_of(end - 1, F.lit(level)) - bin_of(start, F.lit(level)) <= 1, level).otherwise(out)
    return out


def binned(rows: DataFrame, start: str, end: str, top: int) -> DataFrame:
    """rows with _level, _bin and whether the level is the interval's own; one row for each bin of its own level and those above."""
    levels = F.explode(F.sequence("_own", F.lit(top)))
    each = rows.withColumn("_level", levels)
    return each.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start), F.col("_level")), bin_of(F.col(end) - 1, F.col("_level"))))).withColumn("_own", F.col("_own") == F.col("_level"))


def level_for(length: int) -> int:
    """A level at which every interval of so many places or fewer touches two bins at most."""
    level = 0
    while level < TOP and 1 << level * STEP < length:
        level += 1
    return level


def sorted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left.join(right, on, how) of two tables that grow with the texts: both are sorted, neither is sent whole to the driver.

    Files of places are many times smaller than their rows, so Spark would take them for small ones and broadcast them.
    """
    return left.join(right.hint("merge"), on, how)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """Each pair of a row of left (start, end) and a row of right (from, to) of the same keys whose intervals share a place, once.

    Ends are excluded; empty intervals, and those with a null, meet nothing. Other columns of both sides must differ in name.
    top is the level of the longest interval (see `level_for`) if it is known; else both sides are read for it first.
    """
    a = left.filter(F.col("start") < F.col("end")).withColumn("_own", own_level(F.col("start"), F.col("end")))
    b = right.filter(F.col("from") < F.col("to")).withColumn("_own", own_level(F.col("from"), F.col("to")))
    if top is None:
        top = max(x or 0 for x in a.agg(F.max("_own")).first() + b.agg(F.max("_own")).first())
    b = binned(b, "from", "to", top).withColumnRenamed("_own", "_right_own")
    both = sorted_join(binned(a, "start", "end", top), b, [*keys, "_level", "_bin"])
    first = F.greatest("start", "from")
    met = (F.col("_own") | F.col("_right_own")) & (F.col("start") < F.col("to")) & (F.col("from") < F.col("end")) & (bin_of(first, F.col("_level")) == F.col("_bin"))
    return both.filter(met).drop("_level", "_bin", "_own", "_right_own")
