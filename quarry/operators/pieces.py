"""Texts with replaced stretches as tables of pieces: which stretch of the original stands where in the text as it is now.

A piece is a stretch of the original that is kept, or one that a change has replaced. Places are mapped both ways by joins of
intervals, and a change that is withdrawn turns its pieces back, without looking for anything in the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dictionary import occurrences
from .intervals import level_for, overlaps
from .trees import cut

# Fixed value: what stands for a clause that was revoked.
REVOKED = "【本条款已撤销】"


def placed(pieces: DataFrame, doc_id: str) -> DataFrame:
    """pieces (doc_id, start, end, change_id, text) with new_start and new_end, where they stand in the text as it is now."""
    along = Window.partitionBy(doc_id).orderBy("start")
    size = F.when(F.col("change_id").isNull(), F.col("end") - F.col("start")).otherwise(F.length("text")).cast("long")
    upto = F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return pieces.drop("new_start", "new_end").withColumn("new_end", upto).withColumn("new_start", F.col("new_end") - size)


def apart(spans: Column) -> Column:
    """From left to right, spans (start, place, ...) that begin where the last one taken has ended."""
    step = lambda kept, s: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= s["start"]), F.concat(kept, F.array(s))).otherwise(kept)
    return F.aggregate(spans, F.slice(spans, 1, 0), step)


def pieces_of(originals: DataFrame, changes: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, change_id, text, new_start, new_end): the pieces of each original text (doc_id, text), all its characters in order.

    changes: change_id, original, text. Every place where a change's original stands is replaced by its text (the mark of
    revoked clauses if that is empty or null); of places that overlap the one further left counts, of those that begin
    together the longer, then the smaller change_id. Kept pieces have a null change_id. An empty or null text has no piece;
    changes of nothing, or that change nothing, do not count. A document's spans meet in its row.
    """
    asked = changes.filter((F.coalesce("original", F.lit("")) != "") & ~F.col("original").eqNullSafe(F.col("text")))
    said = F.when(F.coalesce("text", F.lit("")) == "", REVOKED).otherwise(F.col("text"))
    first = asked.groupBy(F.col("original").alias("term")).agg(F.min_by(F.struct("change_id", said.alias("text")), "change_id").alias("change"))
    found = occurrences(asked.select(F.col("original").alias("term")), originals, doc_id).join(first, "term")
    spans = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("far"), F.col("change.change_id").alias("change_id"), "end", F.col("change.text").alias("text"))))
    lists = found.groupBy(doc_id).agg(spans.alias("_s"))
    rows = originals.select(doc_id, F.length("text").cast("long").alias("_n")).filter("_n > 0").join(lists, doc_id, "left")
    kind = "array<struct<start:long,end:long,change_id:%s,text:string>>" % changes.schema["change_id"].dataType.simpleString()
    taken = rows.withColumn("_s", F.transform(apart(F.col("_s")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["change_id"].alias("change_id"), s["text"].alias("text"))))
    taken = taken.withColumn("_s", F.coalesce("_s", F.array().cast(kind)))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("_s", lambda s: s["end"]))
    ends = F.concat(F.transform("_s", lambda s: s["start"]), F.array(F.col("_n")))
    null = F.lit(None)
    between = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"), null.cast(changes.schema["change_id"].dataType).alias("change_id"), null.cast("string").alias("text"))), lambda p: p["start"] < p["end"])
    every = taken.select(doc_id, F.explode(F.concat("_s", between)).alias("p")).select(doc_id, "p.*")
    return placed(every, doc_id)


def withdrawn(pieces: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """pieces without the changes in gone (change_id): their stretches are kept again, and what follows moves back."""
    marks = gone.select("change_id").distinct().withColumn("_gone", F.lit(True))
    rows = pieces.join(marks, "change_id", "left")
    back = lambda c: F.when(F.col("_gone").isNull(), F.col(c)).alias(c)
    return placed(rows.select(doc_id, "start", "end", back("change_id"), back("text")), doc_id)


def text_now(pieces: DataFrame, originals: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text): originals as they read now; the pieces of a document meet in its row."""
    lists = pieces.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("start", "end", "change_id", F.col("text").alias("said")))).alias("_p"))
    rows = originals.select(doc_id, "text").join(lists, doc_id, "left")
    parts = F.transform("_p", lambda p: F.when(p["change_id"].isNull(), F.substring(F.col("text"), (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))).otherwise(p["said"]))
    return rows.select(doc_id, F.coalesce(F.array_join(parts, ""), "text").alias("text"))


def to_new(places: DataFrame, pieces: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """places (doc_id, place) with now: where a character of the original stands now; null if it was replaced or is none."""
    return moved(places, pieces, doc_id, "start", "end", "new_start", "now")


def to_old(places: DataFrame, pieces: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """places (doc_id, place) with was: where a character of the text as it is now stood; null if a change put it in or it is none."""
    return moved(places, pieces, doc_id, "new_start", "new_end", "start", "was")


def moved(places: DataFrame, pieces: DataFrame, doc_id: str, start: str, end: str, other: str, name: str) -> DataFrame:
    # Written once, for its longest piece is looked for before the join; else all texts would be searched twice.
    kept = cut(pieces.filter("change_id IS NULL").select(doc_id, F.col(start).alias("from"), F.col(end).alias("to"), F.col(other).alias("_at")), "kept")
    points = places.select(doc_id, F.col("place").alias("start"), (F.col("place") + 1).alias("end")).distinct()
    longest = kept.agg(F.max(F.col("to") - F.col("from"))).first()[0] or 0
    found = overlaps(points, kept, [doc_id], level_for(longest)).select(doc_id, F.col("start").alias("place"), (F.col("_at") + F.col("start") - F.col("from")).alias(name))
    return places.join(found, [doc_id, "place"], "left")
