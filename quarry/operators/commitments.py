"""Commitments of sections against the facts of a project: what contradicts them and what is to be verified."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lots import blanked, by_lots
from ..functions.text import CODE_FENCE, PLACEHOLDER, stripped, text_of
from .checks import commitment_relations
from .quantities import extracted

AROUND = 18
CODES = {"conflict": "fact_conflict", "stronger": "as_good", "incomparable": "other_unit", "scope_unknown": "other_scope"}


def masked(text: Column, *forms: str) -> Column:
    """Text in which all that matches is blank, with its length and its lines as they were."""
    return by_lots(blanked(*forms), "string", pa.string())(text)


def excerpt(text: Column, start: Column, end: Column) -> Column:
    """What stands around a place (from 0) in its line, with dots where the line goes on, and the number of the line."""
    before, after = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    line = F.size(F.split(before, "\n", -1))
    head, tail = F.element_at(F.split(before, "\n", -1), -1), F.element_at(F.split(after, "\n", -1), 1)
    cut_head, cut_tail = F.length(head) > AROUND, F.length(tail) > AROUND
    said = stripped(F.concat(F.when(cut_head, F.substring(head, -AROUND, AROUND)).otherwise(head), F.substring(text, start + 1, end - start), F.substring(tail, 1, AROUND)))
    return F.struct(F.concat(F.when(cut_head, "…").otherwise(""), said, F.when(cut_tail, "…").otherwise("")).alias("text"), line.alias("line"))


def place_of(q: str) -> Column:
    return F.concat_ws("|", f"{q}.severity", f"{q}.scope", f"{q}.subject")


def fact_quantities(facts: DataFrame) -> DataFrame:
    """topic, scope, dimension, number, value, approx, comparator of facts (label, text, topic): the quantities of "label：text"
    that name a topic; a fact with a topic of its own gives it to those that name none."""
    said = F.when(F.col("topic").isNull(), F.concat("label", F.lit("："), text_of(F.col("text")))).otherwise(text_of(F.col("text")))
    rows = facts.select(F.explode(extracted(said, F.col("topic"))).alias("q")).filter("q.topic IS NOT NULL")
    return rows.select("q.topic", place_of("q").alias("scope"), "q.dimension", "q.number", "q.value", "q.approx", "q.comparator")


def check_commitments(sections: DataFrame, facts: DataFrame, labels: dict[str, list[str]] | None = None) -> DataFrame:
    """section_id, start, topic, label, level, code, excerpt, line of every commitment (section_id, text) that no fact backs.

    blocking: it contradicts the facts of its topic. verify: it is as good as a fact, has another unit or scope than the facts
    of its topic, or there is no fact of its topic. Code and marks still to be filled in are not read; quantities without a topic count
    only if they are promised. labels are the known scopes, subjects and grades (a short list).
    """
    text = text_of(F.col("text"))
    found = sections.select("section_id", text.alias("_text"), F.explode(extracted(text, labels=labels, hidden=(CODE_FENCE, PLACEHOLDER))).alias("q")).filter("q.topic IS NOT NULL OR q.committed")
    claims = found.select("section_id", "q.start", "q.end", "q.topic", "q.label", "q.dimension", "q.number", "q.value", "q.approx", "q.comparator", place_of("q").alias("scope"), excerpt(F.col("_text"), F.col("q.start"), F.col("q.end")).alias("at"))
    told = commitment_relations(claims, facts).filter("relation != 'backed'")
    known = facts.select("topic").distinct().withColumn("_known", F.lit(True))
    rows = told.join(F.broadcast(known), "topic", "left")  # a row a topic
    code = F.when(F.col("_known"), F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), F.col("relation"))).otherwise("no_fact")
    return rows.withColumn("code", code).select("section_id", "start", "topic", "label", F.when(F.col("code") == "fact_conflict", "blocking").otherwise("verify").alias("level"), "code", F.col("at.text").alias("excerpt"), F.col("at.line").alias("line"))


def section_report(sections: DataFrame, issues: DataFrame) -> DataFrame:
    """section_id, blocking, verify, passed for every section; an empty one is blocked."""
    sums = issues.groupBy("section_id").agg(F.count_if(F.col("level") == "blocking").alias("blocking"), F.count_if(F.col("level") == "verify").alias("verify"))
    empty = (stripped(text_of(F.col("text"))) == "").cast("int")
    rows = sections.join(sums, "section_id", "left").select("section_id", (F.coalesce("blocking", F.lit(0)) + empty).alias("blocking"), F.coalesce("verify", F.lit(0)).alias("verify"))
    return rows.withColumn("passed", F.col("blocking") == 0)
