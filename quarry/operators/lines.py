"""Operators on the lines of documents (rows doc_id, pos, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REPEATS_KEPT, SHORT_LINE, lines, noise_line, without_blanks


def without_noise(rows: DataFrame) -> DataFrame:
    """Lines that are worth keeping: not blank, no page number, no contents line, and of a short line its first three places."""
    rows = rows.filter(~noise_line(F.col("line"))).withColumn("_bare", without_blanks(F.col("line")))
    place = F.row_number().over(Window.partitionBy("doc_id", F.when(F.length("_bare") <= SHORT_LINE, F.col("_bare")), F.when(F.length("_bare") > SHORT_LINE, F.col("pos"))).orderBy("pos"))
    return rows.withColumn("_place", place).filter((F.length("_bare") > SHORT_LINE) | (F.col("_place") <= REPEATS_KEPT)).drop("_bare", "_place")


def kept_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and kept, the lines (pos, line) of each document by the rule of `without_noise`, in order; nothing is shuffled."""
    cut = F.transform(lines(F.col(text)), lambda line, i: F.struct(without_blanks(line).alias("bare"), i.alias("pos"), line.alias("line")))
    clean = F.array_sort(F.filter(cut, lambda x: ~noise_line(x["line"])))
    # Equal lines stand together: the fourth of them has the first one three places before it.
    few = lambda s: F.filter(s, lambda x, i: (F.length(x["bare"]) > SHORT_LINE) | F.coalesce(F.get(s, i - REPEATS_KEPT)["bare"] != x["bare"], F.lit(True)))
    kept = F.element_at(F.transform(F.array(clean), few), 1)
    return docs.select("doc_id", F.array_sort(F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line")))).alias("kept"))


def repeated(rows: DataFrame) -> DataFrame:
    """Lines that stand more than once in a document, blank ones aside."""
    return rows.filter(without_blanks(F.col("line")) != "").groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n > 1")


def furniture(docs: DataFrame, group: str, share: float = 0.3, least: int = 2) -> DataFrame:
    """Short lines that stand in at least `least` documents of a group and in `share` of them: running heads and feet."""
    bare = F.array_distinct(F.transform(lines(F.col("text")), without_blanks))
    each = docs.select(group, F.explode(bare).alias("line")).filter((F.col("line") != "") & (F.length("line") <= SHORT_LINE))
    counts = each.groupBy(group, "line").agg(F.count("*").alias("docs"))
    totals = docs.groupBy(group).agg(F.count("*").alias("total"))
    return counts.join(totals, group).filter(F.col("docs") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("total")))).select(group, "line", "docs")


def without_furniture(rows: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """Rows (group, line, ...) whose line is not a running head or foot of its group."""
    return rows.withColumn("_bare", without_blanks(F.col("line"))).join(found.select(group, F.col("line").alias("_bare")), [group, "_bare"], "left_anti").drop("_bare")


def merged_titles(rows: DataFrame, title: str, id_col: str, member: str) -> DataFrame:
    """key, id_col, title, member: for each row (member) the title without blanks and case, and of the rows that share it the least identifier with its title.

    One row for each distinct identifier of a title, so a title that very many rows share, the blank one too, is no single row.
    """
    keyed = rows.select(F.lower(without_blanks(F.col(title))).alias("key"), F.col(id_col).alias(member), F.col(title).alias("_title"))
    first = keyed.groupBy("key").agg(F.min(member).alias(id_col), F.min_by("_title", member).alias(title))
    return keyed.select("key", member).distinct().join(first, "key").select("key", id_col, title, member)
