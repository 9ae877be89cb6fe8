"""Assets as evidence: which may be used, what is linked to an item, and what is missing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import parse_date
from ..functions.text import stripped, text_of
from .checks import BLOCKING, STATUS_ORDER
from .links import worst

MOST_ASSETS = 8
NOT_MENTIONED = "未提及"


def usable(assets: DataFrame) -> DataFrame:
    """Assets that are no examples."""
    return assets.filter(~F.col("status").eqNullSafe("example"))


def split_blocked(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets (with problems, an array of codes) that may be used, and the others with their reason: their first blocking problem."""
    reason = F.get(F.filter(F.coalesce("problems", F.array().cast("array<string>")), lambda c: c.isin(*BLOCKING)), F.lit(0))
    rows = assets.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def report(items: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """item_id, status, links, missing of every item that needs material or has links.

    items: item_id, needed. links: item_id, key. assets: key, status (complete or a problem's). The status is the worst of the
    linked assets, to which a link without an asset adds; without links an item is not linked.
    """
    known = assets.select("key", F.col("status").alias("_status"), F.lit(True).alias("_known")).dropDuplicates(["key"])
    each = links.select("item_id", "key").distinct().join(known, "key", "left").withColumn("_status", F.when(F.col("_known"), F.col("_status")).otherwise("broken link"))
    status = worst(each, ["item_id"], "_status", STATUS_ORDER, "complete").withColumnRenamed("_status", "status")
    lists = each.groupBy("item_id").agg(F.count("_known").alias("links"), F.array_sort(F.collect_list(F.when(F.col("_known").isNull(), F.col("key")))).alias("missing"))
    rows = items.join(status.join(lists, "item_id"), "item_id", "left").filter(F.col("needed") | F.col("status").isNotNull())
    return rows.select("item_id", F.coalesce("status", F.lit("not linked")).alias("status"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "complete").alias("complete"))


def index_rows(items: DataFrame, mapped: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """item_id, sections (id, written), attachments (key, file) and missing links of every item, each list in order.

    mapped: item_id, id, written. assets: key, files (array). The lists are those of one item.
    """
    own = mapped.groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct("id", "written"))).alias("sections"))
    each = links.join(assets.select("key", "files", F.lit(True).alias("_known")), "key", "left")
    files = each.groupBy("item_id").agg(
        F.array_sort(F.flatten(F.collect_list(F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda f: F.struct(F.col("key").alias("key"), f.alias("file")))))).alias("attachments"),
        F.array_sort(F.collect_set(F.when(F.col("_known").isNull(), F.col("key")))).alias("missing"),
    )
    rows = items.select("item_id").join(own, "item_id", "left").join(files, "item_id", "left")
    empty = lambda c, like: F.coalesce(c, F.array().cast(like.schema[c].dataType))
    return rows.select("item_id", empty("sections", own).alias("sections"), empty("attachments", files).alias("attachments"), empty("missing", files).alias("missing"))


def relevant(scored: DataFrame, owner: str, least: float, most: int = MOST_ASSETS) -> DataFrame:
    """Of the assets of each owner (owner, key, score) those of at least `least`, the best first; where none is, all; `most` of them."""
    best = Window.partitionBy(owner)
    rows = scored.withColumn("_hit", F.max(F.col("score") >= least).over(best)).filter(~F.col("_hit") | (F.col("score") >= least))
    order = [F.when(F.col("_hit"), -F.col("score")).otherwise(0.0), F.col("key")]
    return rows.withColumn("rank", F.row_number().over(best.orderBy(*order))).filter(F.col("rank") <= most).drop("_hit")


def by_kind(linked: DataFrame) -> DataFrame:
    """owner, kind, keys: linked assets (owner, pos, kind, key, status) by kind in the order of links, without examples."""
    own = F.array_sort(F.collect_list(F.struct("pos", "key")))
    return usable(linked).groupBy("owner", "kind").agg(F.transform(own, lambda x: x["key"]).alias("keys"))


def gaps(references: Column, assets: Column, excluded: Column) -> Column:
    """What a section lacks, from counts of its references, its assets and the assets that were kept out."""
    said = [F.when(references == 0, "no reference"), F.when(assets == 0, "no asset"), F.when(excluded > 0, F.concat(excluded, F.lit(" assets kept out")))]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def deadline(raw: Column, today: date) -> Column:
    """The day of a stated deadline and where it is from; today where none is stated or it cannot be read."""
    day = F.when(stripped(text_of(raw)) != NOT_MENTIONED, parse_date(raw))
    return F.struct(F.coalesce(day, F.lit(today)).alias("day"), F.when(day.isNotNull(), "stated").when(raw.isNull(), "today").otherwise("today, not readable").alias("source"))
