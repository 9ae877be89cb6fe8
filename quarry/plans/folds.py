"""Folds over texts that SQL cannot state; tested on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks, quantities
from ..sources.tables import table
from .registry import query


@query()
def chunked(spark, sf_dir):
    return chunks.chunked(table(spark, sf_dir, "documents"))


@query()
def quantity_mentions(spark, sf_dir):
    """Quantities in the turns of conversations, with one stated fact put in front of each."""
    text = F.concat(F.lit("承诺响应时间"), F.col("turn") + 1, F.lit("小时，质保两年。"), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(quantities.extracted(text)).alias("q"))
    return rows.select("conv_id", "turn", "q.*")
