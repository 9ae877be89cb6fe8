"""Numbers, points, units, dates and vector measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS, stripped, text_of

# Units, what they measure and how many of the base unit they are.
UNITS = {
    "分钟": ("minute", 1), "小时": ("minute", 60), "个小时": ("minute", 60), "工作日": ("workday", 1), "个工作日": ("workday", 1),
    "日历天": ("day", 1), "日历日": ("day", 1), "个日历日": ("day", 1), "个日历天": ("day", 1), "自然日": ("day", 1), "天": ("day", 1),
    "日": ("day", 1), "周": ("day", 7), "个月": ("day", 30), "年": ("day", 365), "名": ("person", 1), "人": ("person", 1), "次": ("times", 1),
}
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
APPROXIMATE_DAYS = 6


# The number of a cell with what may stand around it, a list of steps after it, and a weight.
CELL = rf"^(.*?)[{BLANKS}（(]*{NUMBER}[{BLANKS}]*分?[{BLANKS}]*[）)]?$"
STEPS = rf"[{BLANKS}]*[（(][0-9.,，、{BLANKS}\-—~～]+[）)][{BLANKS}]*$"
WEIGHT = rf"{NUMBER}[{BLANKS}]*[%％]"
IDEOGRAPH = r"[\x{4e00}-\x{9fff}]"


def cell_text(text: Column) -> Column:
    """A cell without blanks around it and without those that line breaks have left between ideographs."""
    return F.regexp_replace(stripped(text_of(text)), rf"(?<={IDEOGRAPH})[{BLANKS}]+(?={IDEOGRAPH})", "")


def points_cell(text: Column) -> Column:
    """Name and points of a cell such as "name (50 points)"; a cell without a number is all name.

    A cell that begins with its number may end in the steps of an award, such as "10 (10, 5, 0)"; they do not count.
    """
    whole = cell_text(text)
    t = F.when(whole.rlike(f"^{NUMBER}"), F.regexp_replace(whole, STEPS, "")).otherwise(whole)
    found = t.rlike(CELL)
    name = F.regexp_replace(F.regexp_extract(t, CELL, 1), r"^[ ：:（(]+|[ ：:（(]+$", "")
    return F.struct(F.when(found, name).otherwise(t).alias("name"), F.when(found, F.regexp_extract(t, CELL, 2).cast("double")).alias("points"))


def category_weight(text: Column) -> Column:
    """Name and weight of a cell such as "technical part 60%"."""
    t = cell_text(text)
    weight = F.regexp_extract(t, WEIGHT, 1)
    name = stripped(F.regexp_replace(t, rf"[（(]?[{BLANKS}]*{WEIGHT}[{BLANKS}]*[）)]?", ""))
    return F.struct(name.alias("name"), F.when(weight != "", weight.cast("double")).alias("weight"))


def same_value(a: Column, b: Column) -> Column:
    """Whether two quantities (structs of value, dimension, approx) agree; months and years allow for six days."""
    slack = F.when(a["dimension"] == "minute", APPROXIMATE_DAYS * 1440).otherwise(APPROXIMATE_DAYS)
    near = F.abs(a["number"] - b["number"]) <= slack
    return (a["dimension"] == b["dimension"]) & F.when(a["number"].isNotNull() & b["number"].isNotNull() & (a["approx"] | b["approx"]), near).otherwise(a["value"] == b["value"])


def parse_date(text: Column, month_end: bool = False) -> Column:
    """A full date, or a year and month (its first or, if asked for, its last day); null where there is none or it does not exist."""
    gap = f"[{BLANKS}]*"
    full = rf"([0-9]{{4}}){gap}[-/.年]{gap}([0-9]{{1,2}}){gap}[-/.月]{gap}([0-9]{{1,2}})"
    month = rf"([0-9]{{4}}){gap}[-/.年]{gap}([0-9]{{1,2}})(?![0-9])"
    t = text_of(text)
    part = lambda form, g: F.regexp_extract(t, form, g)
    day = F.try_to_date(F.concat_ws("-", part(full, 1), F.lpad(part(full, 2), 2, "0"), F.lpad(part(full, 3), 2, "0")), "yyyy-MM-dd")
    first = F.try_to_date(F.concat_ws("-", part(month, 1), F.lpad(part(month, 2), 2, "0"), F.lit("01")), "yyyy-MM-dd")
    return F.when(t.rlike(full), day).when(t.rlike(month), F.last_day(first) if month_end else first)


def usable_vector(vector: Column) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def bands(score: Column) -> Column:
    """Rating of a score of 100."""
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "to improve").otherwise("at risk")
