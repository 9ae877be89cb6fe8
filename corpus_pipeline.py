"""Cleaning of a document table in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from quarry.llm.common import clear, stage
from quarry.llm.tokenize import vocabulary_path

#: Two stages are built on binary formats and trained models, which SQL cannot express.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5, with all their columns; no text is shuffled.

    The model learns from the labelled rows of docs outside the held-out fold. Null and empty texts have the score of a
    text about which nothing is known. An empty table, or one without labels, stays as it is or is judged by the labels' share.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.filter(~quality.held_out()))
    return quality.keep_predicted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (after blanks are folded): that with the smallest doc_id.

    A row is known by its doc_id (null like any other value) and text; of rows that repeat both, one stays.
    """
    rows = stage(exact_dedup.exact_dedup(docs), "copies")
    kept = rows.filter("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    text_sha = F.sha2(exact_dedup.normalised(docs["text"]), 256)
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["keep_id"]) & (text_sha == kept["keep_sha"]), "left_semi")
    repeated = rows.groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if repeated.isEmpty():
        return out
    sha = "text_sha"
    while sha in docs.columns:
        sha += "_"
    return out.withColumn(sha, F.sha2(exact_dedup.normalised(F.col("text")), 256)).dropDuplicates(["doc_id", sha]).drop(sha)


def known_by(docs: DataFrame):
    """doc_id, or where it is null a number made from the text: rows without doc_id are known by their texts."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(1 << 62) + F.xxhash64(docs["text"]).bitwiseAND(F.lit((1 << 62) - 1)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id, one without doc_id only if no other is there.

    Rows without doc_id are known by their texts; rows that repeat a doc_id stay or go together.
    """
    classes = jaccard_join.jaccard_join(docs.select(known_by(docs).alias("doc_id"), docs["text"].alias("text")))
    gone = stage(classes.filter("doc_id != class_id").select(F.col("doc_id").alias("gone_id")).distinct(), "near-copies")
    return docs.join(gone, known_by(docs) == gone["gone_id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark: under 5 % of their words lie in its windows.

    Rows that share a doc_id are judged as one document; rows without doc_id are known by a hash of their text.
    """
    key = known_by(docs)
    hits = decontaminate.decontaminate(docs.select(key.alias("doc_id"), docs["text"].alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stage(decontaminate.contamination(hits).filter("contaminated").select(F.col("doc_id").alias("gone_id")).distinct(), "contaminated")
    return docs.join(gone, key == gone["gone_id"], "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the text that they decode to, for every document."""
    rows = bpe.bpe_encode(docs, vocabulary_path("word_bpe_49k.json"), decode=True)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder before the next stage begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
        clear(spark, keep=docs)
    return docs
