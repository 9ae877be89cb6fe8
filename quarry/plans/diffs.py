"""Differences of versions over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, lines
from ..operators import diffs
from ..sources.tables import table
from .registry import query


def turns(spark, sf_dir):
    """Each turn of a conversation as the next version of the one before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", before.alias("old"), F.col("text").alias("new"))


@query()
def text_diff(spark, sf_dir):
    """Turns against those before them, whole; parts as one text."""
    rows = diffs.text_diff(turns(spark, sf_dir), ["conv_id", "turn"], "old", "new")
    return rows.select("conv_id", "turn", "pos", "type", "text", F.array_join(F.transform("parts", lambda p: F.concat(p["type"], F.lit(":"), p["text"])), "|").alias("parts"))


#: Documents and drafts of them that lack all lines that begin with one of some letters.
DROPPED = "[A-HÄÉ]"
DRAFTS = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
d AS (SELECT doc_id, sum(length(regexp_replace(line, '[{BLANKS}]+', '', 'g'))) AS bare, sum(length(line) + 1) AS whole FROM l WHERE regexp_matches(line, '^{DROPPED}') GROUP BY doc_id) """


def drafts(spark, sf_dir):
    kept = F.array_join(F.filter(lines(F.col("text")), lambda x: ~x.rlike("^" + DROPPED)), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"), kept.alias("new"))


@query(DRAFTS + "SELECT doc_id, CAST(0 AS BIGINT) AS added, CAST(coalesce(bare, 0) AS BIGINT) AS removed, bare IS NOT NULL AS changed FROM documents LEFT JOIN d USING (doc_id) WHERE text != ''")
def draft_stats(spark, sf_dir):
    return diffs.diff_stats(diffs.text_diff(drafts(spark, sf_dir), ["doc_id"], "old", "new"), ["doc_id"])


@query(DRAFTS + "SELECT doc_id, CAST(coalesce(whole, 0) AS BIGINT) AS edited, coalesce(whole, 0) / greatest(length(trim(coalesce(text, ''))), 1) AS ratio FROM documents LEFT JOIN d USING (doc_id)")
def edit_ratios(spark, sf_dir):
    return diffs.edit_ratios(drafts(spark, sf_dir), ["doc_id"], "old", "new")
