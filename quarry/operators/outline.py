"""Outlines from scoring items: the items of a package, what they ask of a chapter, and chapters that cover all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_of
from .coverage import content_points
from .projects import cn_number, points_text

# Answers that make chapters, titles of the chapters that several items share, and what is written into requirements.
SINGLE, SHARED = "proposal", {"compliance": "技术需求逐条响应", "demo": "现场演示方案", "evidence": "商务资信与证明材料"}
ITEM, COVER, PROOF, FLAW = "评分项：", "须覆盖：", "证明材料：", "瑕疵"
FLAWLESS = "评审按“瑕疵”扣分：内容须完整、无漏项、表述准确、具有针对性"
MOST_REQUIREMENTS, NOTE_CHARS = 8, 80
CHAPTER = "^第[一二三四五六七八九十百0-9]+章\\s*"


def target_items(items: DataFrame) -> DataFrame:
    """Items (project, pos, package, answer, target) that make chapters, of the project's target package or, where no item is in
    that, of the package of its first item."""
    own = items.groupBy("project").agg(F.max(F.when(F.col("package") == F.col("target"), F.col("package"))).alias("_target"), F.min_by("package", "pos").alias("_first"))
    rows = items.join(own, "project").filter(F.col("package") == F.coalesce("_target", "_first"))
    return rows.filter(F.col("answer").isin(SINGLE, *SHARED)).drop("_target", "_first")


def item_requirements(name: Column, points: Column, parts: Column, criteria: Column, answer: Column, note: Column) -> Column:
    """What an item asks of its chapter: itself with its points, what is to be covered, proof, and care where flaws cost points."""
    none = F.array().cast("array<string>")
    cover = F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, parts).otherwise(content_points(criteria))
    proof = F.when((answer == "evidence") & (text_of(note) != ""), F.array(F.concat(F.lit(PROOF), F.substring(note, 1, NOTE_CHARS)))).otherwise(none)
    care = F.when(F.contains(F.concat(text_of(criteria), text_of(note)), F.lit(FLAW)), F.array(F.lit(FLAWLESS))).otherwise(none)
    first = F.array(F.concat(F.lit(ITEM), name, F.lit("（"), points_text(points), F.lit("）")))
    return F.slice(F.concat(first, F.transform(cover, lambda p: F.concat(F.lit(COVER), p)), proof, care), 1, MOST_REQUIREMENTS)


def rubric_chapters(items: DataFrame) -> DataFrame:
    """project, place (a struct that orders chapters), title, item_ids: a chapter for each proposal, then one for each other kind of answer.

    items: project, pos, item_id, name, answer. A single demonstration gives its chapter its name.
    """
    single = items.filter(F.col("answer") == SINGLE).select("project", F.struct(F.lit(0).alias("kind"), F.col("pos").cast("long").alias("pos")).alias("place"), F.col("name").alias("title"), F.array("item_id").alias("item_ids"))
    kinds = list(SHARED)
    kind = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("answer")).cast("int")
    shared = items.filter(F.col("answer").isin(*kinds)).withColumn("_kind", kind).groupBy("project", "answer", "_kind")
    shared = shared.agg(F.count("*").alias("_n"), F.min("name").alias("_name"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_id"))), lambda x: x["item_id"]).alias("item_ids"))  # the items of a project
    title = F.when((F.col("answer") == "demo") & (F.col("_n") == 1), F.col("_name")).otherwise(F.element_at(F.create_map(*[F.lit(x) for pair in SHARED.items() for x in pair]), F.col("answer")))
    return single.unionByName(shared.select("project", F.struct(F.col("_kind").alias("kind"), F.lit(0).cast("long").alias("pos")).alias("place"), title.alias("title"), "item_ids"))


def numbered(chapters: DataFrame) -> DataFrame:
    """project, number, title (with its number in front), item_ids."""
    rows = chapters.withColumn("number", F.row_number().over(Window.partitionBy("project").orderBy("place")))
    bare = F.regexp_replace("title", CHAPTER, "")
    return rows.select("project", "number", F.concat(F.lit("第"), cn_number(F.col("number")), F.lit("章 "), bare).alias("title"), "item_ids")


def covering(chapters: DataFrame, items: DataFrame) -> DataFrame:
    """Chapters (project, place as a long, title, item_ids) without unknown items, followed by chapters for items that none carries; not numbered yet."""
    known = items.select("project", "item_id").distinct()
    each = chapters.select("project", "place", F.posexplode("item_ids").alias("_n", "item_id")).join(known, ["project", "item_id"])
    kept = each.groupBy("project", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "item_id"))), lambda x: x["item_id"]).alias("item_ids"))
    none = F.array().cast(items.select(F.array("item_id")).schema[0].dataType)
    own = chapters.drop("item_ids").join(kept, ["project", "place"], "left").withColumn("item_ids", F.coalesce("item_ids", none)).withColumn("place", F.struct(F.lit(-1).alias("kind"), F.col("place").cast("long").alias("pos")))
    missing = items.join(each.select("project", "item_id").distinct(), ["project", "item_id"], "left_anti")
    return own.select("project", "place", "title", "item_ids").unionByName(rubric_chapters(missing))
