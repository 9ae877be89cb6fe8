"""Bookmarks of a document matched to its paragraphs, in order, and turned down where they do not cover its chapters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of
from .diffs import increasing
from .sections import heading_level, numbering_class

# Pages that a bookmark may point too far, matches that make bookmarks worth keeping, lines of a wrapped title.
PAGES_BACK, LEAST, LEAST_SHARE, WRAPPED = 2, 3, 0.3, 2


def key(text: Column) -> Column:
    """Letters, digits and ideographs of a text."""
    return F.regexp_replace(text_of(text), r"[^\p{L}\p{N}]", "")


def matched(marks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, k, paragraph): bookmarks (doc_id, k, level, title, page from 1) with paragraphs (doc_id, paragraph, page from 0, lines, text).

    A paragraph fits if its letters hold the title's, or begin the title and take two lines at most, on the bookmark's page or
    up to PAGES_BACK before it or the next. Of all fitting pairs the longest chain that rises in both orders is taken; the
    pairs of a document meet in one task. A document with fewer than LEAST matches or LEAST_SHARE of its bookmarks has none.
    """
    asked = marks.select("doc_id", "k", key(F.col("title")).alias("_title"), "page").filter("_title != ''")
    near = asked.select("doc_id", "k", "_title", F.explode(F.sequence(F.col("page") - PAGES_BACK, F.col("page"))).alias("page"))
    own = paragraphs.select("doc_id", "paragraph", "page", "lines", key(F.col("text")).alias("_key"))
    fits = F.contains("_key", F.col("_title")) | ((F.col("_key") != "") & F.startswith("_title", F.col("_key")) & (F.col("lines") <= WRAPPED))
    pairs = near.join(own, ["doc_id", "page"]).filter(fits)

    def chain(ks: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([[{"k": k, "paragraph": p} for k, p in increasing([(int(x), -int(y)) for x, y in zip(a, b, strict=True)])] for a, b in zip(ks, places, strict=True)], dtype=object)

    kind = ", ".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c, df in (("k", marks), ("paragraph", paragraphs)))
    lists = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", (-F.col("paragraph")).alias("p")))).alias("_pairs"))  # the pairs of one document
    own = lists.select("doc_id", F.pandas_udf(chain, f"array<struct<{kind}>>")(F.col("_pairs.k"), F.col("_pairs.p")).alias("_chain"))
    good = own.join(marks.groupBy("doc_id").agg(F.count("*").alias("_all")), "doc_id").filter(F.size("_chain") >= F.greatest(F.lit(LEAST), F.col("_all") * LEAST_SHARE))
    return good.select("doc_id", F.explode("_chain").alias("x")).select("doc_id", "x.k", "x.paragraph")


def covering(found: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """found without documents of three chapters or more, told by their numbering, of which bookmarks miss more than half."""
    chapters = paragraphs.filter((numbering_class(F.col("text")) == "part") & (heading_level(F.col("text")) == 1)).select("doc_id", "paragraph")
    seen = chapters.join(found.select("doc_id", "paragraph", F.lit(1).alias("_marked")), ["doc_id", "paragraph"], "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("_marked").alias("marked"))
    bad = seen.filter((F.col("n") >= 3) & ((F.col("n") - F.col("marked")) * 2 > F.col("n"))).select("doc_id")
    return found.join(bad, "doc_id", "left_anti")


def headings(marks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, level, title): paragraphs that bookmarks name, for documents whose bookmarks can be trusted."""
    found = covering(matched(marks, paragraphs), paragraphs)
    return found.join(marks.select("doc_id", "k", "level"), ["doc_id", "k"]).join(paragraphs.select("doc_id", "paragraph", F.col("text").alias("title")), ["doc_id", "paragraph"]).select("doc_id", "paragraph", "level", "title")
