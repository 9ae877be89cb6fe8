"""Coverage of weighted requirements by written sections, points, outlines and word budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body_chars, stripped, text_of
from .matching import forms, mentioned_in
from .trees import cut, leaves, most_specific

MIN_LENGTH_RATIO = 0.3
# What introduces a list of points and what ends it, how points are separated and numbered, and two forms without
# an introduction: numbered demonstrations or schemes, and a list inside a sentence.
OPENING = "(?:内容包括|内容包含|主要包括|包括以下内容|包括|包含)[：:]"
CLOSING = r"上述|以上内容|不存在瑕疵|方案内容|。\s*(?![①-⑩0-9（(])"
SEPARATOR = r"[；;]|(?=[①-⑩])|\s+(?=[0-9]{1,2}[.、．）)])"
ORDINAL = r"^\s*(?:[①-⑩]|[0-9]{1,2}[.、．）)]|[（(][0-9]{1,2}[）)])\s*"
NUMBERED = r"(?:^|\s)[0-9]{1,2}[.、．]\s*([^\s，。；;（(]{2,24}?(?:演示|方案))"
INLINE = "包括([^。：:；;，,]{4,80}?)等"
MOST_POINTS, POINT_CHARS, INLINE_CHARS = 8, (2, 40), (2, 20)
# How much text a kind of answer needs for the same points.
KIND_FACTOR = {"proposal": 1.0, "demo": 0.3, "compliance": 0.25, "evidence": 0.2}


def content_points(criteria: Column, most: int = MOST_POINTS) -> Column:
    """Points that criteria list, distinct and in their order.

    They follow an opening such as "includes:", up to where the list ends; else they are numbered demonstrations or schemes;
    else the parts, two at least, of a list inside a sentence.
    """
    text = text_of(criteria)
    strip = lambda p: F.regexp_replace(p, "^[ 。；;，,、　]+|[ 。；;，,、　]+$", "")
    listed = F.split(F.regexp_extract(text, f"(?s){OPENING}(.*)$", 1), CLOSING, 2)[0]
    opened = F.transform(F.split(listed, SEPARATOR), lambda p: F.regexp_replace(strip(F.regexp_replace(p, ORDINAL, "")), "等$", ""))
    opened = F.filter(opened, lambda p: F.length(p).between(*POINT_CHARS))
    numbered = F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1))
    inline = F.filter(F.transform(F.split(F.regexp_extract(text, INLINE, 1), "、"), stripped), lambda p: p != "")
    inline = F.when(F.size(inline) >= 2, F.filter(inline, lambda p: F.length(p).between(*INLINE_CHARS))).otherwise(F.array().cast("array<string>"))
    found = F.when(text.rlike(OPENING), opened).when(F.size(numbered) > 0, numbered).otherwise(inline)
    return F.slice(F.array_distinct(found), 1, most)


def coverage(items: DataFrame, nodes: DataFrame, mapped: DataFrame, reach: DataFrame) -> DataFrame:
    """item_id, points, status, coverage, n_points, missing (points not found), words and budget for every item.

    items: item_id, points, kind, wanted (array of points). nodes: id, parent_id, title, content, budget. mapped: item_id, id.
    Of nested carriers the most specific count. Their subtrees' titles and texts are searched section by section; a point is
    found if any section mentions it. A proposal with less than 30 % of its written sections' budget has half the coverage.
    What is asked of a section comes to it as one list, so its text is joined once, however many items its chapters carry.
    """
    carriers = most_specific(mapped.select("item_id", "id").distinct(), reach)
    inside = reach.select(F.col("ancestor").alias("carrier"), "id").join(carriers.withColumnRenamed("id", "carrier"), "carrier").select("item_id", "id").distinct()
    leaf = leaves(nodes).select("id", F.lit(True).alias("leaf"))
    told = nodes.join(leaf, "id", "left").select("id", "title", "content", F.coalesce("leaf", F.lit(False)).alias("leaf"), F.coalesce("budget", F.lit(0)).alias("budget"), (stripped(text_of(F.col("content"))) != "").alias("written"))
    wanted = items.select("item_id", F.coalesce("wanted", F.array().cast("array<string>")).alias("wanted"))
    asked = inside.join(wanted, "item_id").groupBy("id").agg(F.collect_list(F.struct("item_id", "wanted")).alias("asked"))
    text, none = F.concat_ws("\n", F.col("title"), F.col("content")), F.array().cast("array<string>")
    hits = F.transform("asked", lambda a: F.struct(a["item_id"].alias("item_id"), F.when(F.col("written"), mentioned_in(a["wanted"], F.col("forms"))).otherwise(none).alias("hit")))
    words = F.when(F.col("written"), body_chars(F.col("content"))).otherwise(0)
    sections = told.join(asked, "id").withColumn("forms", F.when(F.col("written"), forms(text)))
    each = sections.select(F.explode(hits).alias("h"), "leaf", "budget", "written", words.alias("words")).select("h.*", "leaf", "budget", "written", "words")
    each = cut(each, "coverage")  # both sums below come from one reading of the texts
    sums = each.groupBy("item_id").agg(
        F.sum(F.when(F.col("leaf"), F.col("budget")).otherwise(0)).alias("budget"), F.sum(F.when(F.col("leaf") & F.col("written"), F.col("budget")).otherwise(0)).alias("written_budget"),
        F.sum("words").alias("words"), F.bool_or("written").alias("written"),
    )
    found = each.select("item_id", F.explode("hit").alias("point")).distinct().groupBy("item_id").agg(F.collect_set("point").alias("found"))  # points of an item: a short list
    rows = items.join(sums, "item_id", "left").join(found, "item_id", "left")
    wanted = F.coalesce("wanted", F.array().cast("array<string>"))
    missing = F.array_except(wanted, F.coalesce("found", F.array().cast("array<string>")))
    needed = F.when(F.col("written_budget") > 0, F.col("written_budget")).otherwise(F.col("budget"))
    short = (F.col("kind") == "proposal") & (needed > 0) & (F.col("words") < needed * MIN_LENGTH_RATIO)
    share = F.when(F.size(wanted) > 0, 1 - F.size(missing) / F.size(wanted)).otherwise(1.0) * F.when(short, 0.5).otherwise(1.0)
    no = F.col("written").isNull()
    unwritten = no | ~F.col("written")
    status = F.when(no, "not carried").when(unwritten, "not written").when(F.size(missing) > 0, "points missing").when(short, "too short").otherwise("covered")
    return rows.select(
        "item_id", "points", status.alias("status"), F.bround(F.when(unwritten, 0.0).otherwise(share), 3).alias("coverage"), F.size(wanted).alias("n_points"),
        F.when(unwritten, F.array().cast("array<string>")).otherwise(F.array_sort(missing)).alias("missing"), F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("budget", F.lit(0)).alias("budget"),
    )


def coverage_rate(covered: DataFrame, *keys: str) -> DataFrame:
    """Coverage weighted by points; unknown or zero points weigh 1."""
    weight = F.when(F.coalesce(F.col("points"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("points"))
    return covered.groupBy(*keys).agg(F.round(F.sum(weight * F.col("coverage")) / F.sum(weight), 6).alias("rate"))


def points_by_package(items: DataFrame, whole: float = 100.0) -> DataFrame:
    """Known points of each package against the whole, and how many items have none."""
    sums = items.groupBy("package").agg(F.round(F.coalesce(F.sum("points"), F.lit(0.0)), 6).alias("points"), F.count_if(F.col("points").isNull()).alias("unknown"))
    return sums.withColumn("complete", (F.abs(F.col("points") - whole) < 0.01) & (F.col("unknown") == 0))


def without_chapter(items: DataFrame, mapped: DataFrame) -> DataFrame:
    return items.join(mapped.select("item_id").distinct(), "item_id", "left_anti")


def shared_points(mapped: DataFrame, items: DataFrame) -> DataFrame:
    """(id, weight): points of each leaf's items times the factor of their kind, divided by the number of carriers."""
    carriers = mapped.groupBy("item_id").agg(F.count("*").alias("carriers"))
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in KIND_FACTOR.items() for x in (k, v)]), F.col("kind")), F.lit(1.0))
    rows = mapped.join(items.join(carriers, "item_id"), "item_id")
    return rows.groupBy("id").agg(F.round(F.sum(F.coalesce("points", F.lit(0.0)) * factor / F.col("carriers")), 6).alias("weight"))


def word_budgets(chapters: DataFrame, leaves: DataFrame, total: int, keys: list[str]) -> DataFrame:
    """keys, chapter_id, leaf_id (null for the chapter itself) and budget in words.

    chapters: keys, chapter_id, weight. leaves: keys, chapter_id, leaf_id, weight (null counts as 1). Chapters share four fifths
    of the total by weight, in hundreds; those without weight have half the least positive one, and where none has any they
    weigh as many as their leaves. A chapter's leaves share its budget by weight, in fifties, with 200 at least.
    """
    lw = F.coalesce(F.col("weight"), F.lit(1.0))
    sums = leaves.groupBy(*keys, "chapter_id").agg(F.sum(lw).alias("_leaves"), F.count("*").alias("_n"))
    own = chapters.join(sums, [*keys, "chapter_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    least = chapters.groupBy(*keys).agg(F.min(F.when(F.col("weight") > 0, F.col("weight"))).alias("_least"))
    own = own.join(least, keys) if keys else own.join(F.broadcast(least))  # one row
    weight = F.when(F.col("_least").isNull(), F.coalesce("_n", F.lit(1)).cast("double")).when(F.col("weight") > 0, F.col("weight")).otherwise(F.col("_least") * 0.5)
    own = own.withColumn("_weight", weight)
    all_of = own.groupBy(*keys).agg(F.sum("_weight").alias("_sum"))
    own = own.join(all_of, keys) if keys else own.join(F.broadcast(all_of))  # one row
    own = own.withColumn("budget", F.bround(F.lit(0.8 * total) * F.col("_weight") / F.col("_sum") / 100, 0).cast("long") * 100)
    below = leaves.withColumn("_weight", lw).select(*keys, "chapter_id", "leaf_id", "_weight").join(own.select(*keys, "chapter_id", F.col("budget").alias("_budget"), "_leaves"), [*keys, "chapter_id"])
    shared = F.greatest(F.lit(200), F.bround(F.col("_budget") * F.col("_weight") / F.col("_leaves") / 50, 0).cast("long") * 50)
    return own.select(*keys, "chapter_id", F.lit(None).cast(leaves.schema["leaf_id"].dataType).alias("leaf_id"), "budget").unionByName(below.select(*keys, "chapter_id", "leaf_id", shared.alias("budget")))


def recent_siblings(nodes: DataFrame, most: int = 3) -> DataFrame:
    """For every node its last `most` written siblings before it, nearest first.

    Written siblings are numbered along their parent, and a node is joined to the numbers just before its own place.
    """
    along = Window.partitionBy("parent_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.withColumn("_before", F.coalesce(F.sum(F.col("written").cast("int")).over(along), F.lit(0)))
    done = placed.filter("written").select("parent_id", (F.col("_before") + 1).alias("_number"), F.col("id").alias("_sibling"))
    near = placed.filter("_before > 0").select("id", "parent_id", F.explode(F.sequence(F.greatest(F.col("_before") - (most - 1), F.lit(1)), F.col("_before"))).alias("_number"))
    found = near.join(done, ["parent_id", "_number"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("_number")).alias("n"), "_sibling"))).alias("found"))
    none = F.transform(F.array(), lambda x: x).cast(f"array<{nodes.schema['id'].dataType.simpleString()}>")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce(F.transform("found", lambda x: x["_sibling"]), none).alias("siblings"))
