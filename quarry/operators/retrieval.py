"""Passage retrieval: BM25, cosine similarity, rank fusion, exclusions, injected scores, pins and provenance.

Every operator answers a table of queries at once. Queries are the small side: their terms or vectors are broadcast up to a
checked number and joined by a shuffle beyond it; rankings are cut per query before anything else is joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import dot, norm, usable_vector
from ..functions.text import text_of
from .links import fused
from .ranks import first_rows
from .trees import cut

#: Rows of queries (their terms, or vectors) that are broadcast at most.
MOST_BROADCAST = 100_000
#: Query vectors that are compared with all vectors at once.
QUERY_BLOCK = 2_000
#: Pairs of a query and a document that are scored in one task at most, on the average.
PAIRS = 1 << 20
# Constants of the ranking functions.
K1, B, NEGATIVE_SHARE = 1.5, 0.75, 0.25
FUSION_K, QUERY_CHARS, PINNED_SCORE = 60, 512, 10.0
WORD = r"[\p{L}\p{N}]+"
#: Scores are compared and reported at so many digits.
DIGITS = 6


def tokens(text: Column) -> Column:
    """Lower-case words. Runs of ideographs are cut into overlapping pairs, for they have no word borders."""
    words = F.regexp_extract_all(F.lower(text_of(text)), F.lit(WORD), F.lit(0))
    ideographs = r"^[\x{3400}-\x{9fff}]+$"
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    cut = F.when(text_of(text).rlike(r"[\x{3400}-\x{9fff}]{2}"), F.flatten(F.transform(words, lambda w: F.when(w.rlike(ideographs) & (F.length(w) > 1), pairs(w)).otherwise(F.array(w)))))
    return F.coalesce(cut, words)


def small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def bm25(docs: DataFrame, queries: DataFrame, most: int | None, doc_id: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score, rank): documents ranked for each query by BM25 over whole texts.

    Only documents that share a term with the query are ranked. A term that more than half of the documents hold has a
    negative weight, which is replaced by a share of the mean weight. Repeated query terms count as often as they occur. Equal
    scores are ranked by identifier. Words are written to the shared folder, so that they are cut out once. Document frequencies
    are counted before the shuffle, a row a term; of the postings only those of query terms are moved, once, to their document.
    """
    words = cut(docs.select(doc_id, tokens(F.col("text")).alias("words")), "words")  # texts are cut into words once
    asked = queries.select(query_id, F.explode(tokens(F.col("text"))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("asked"))
    frequencies = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    sizes = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean_size"))
    weights = frequencies.join(F.broadcast(sizes)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    floor = weights.agg(F.avg("idf").alias("mean_idf"))
    weights = weights.join(small(asked.select("term").distinct()), "term", "left_semi").join(F.broadcast(floor))  # one row
    weights = weights.select("term", "mean_size", F.when(F.col("idf") < 0, NEGATIVE_SHARE * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    terms = small(cut(asked.join(weights, "term"), "terms"))  # a row a query term
    postings = words.select(doc_id, F.size("words").alias("size"), F.explode("words").alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi")
    # A document's postings meet in one task, so its scores are complete there: what is moved on is the best of each query in each task.
    n_pairs = words.count() * asked.select(query_id).distinct().count()
    n_parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_pairs // PAIRS))
    counts = postings.repartition(n_parts, doc_id).groupBy(doc_id, "size", "term").agg(F.count("*").alias("tf"))
    part = F.col("asked") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    scored = counts.join(terms, "term").groupBy(query_id, doc_id).agg(F.round(F.sum(part), DIGITS).alias("score"))
    return ranked(scored, query_id, doc_id, most)


def ranked(scored: DataFrame, query_id: str, doc_id: str, most: int | None) -> DataFrame:
    return first_rows(scored, [query_id], [F.desc("score"), F.asc(doc_id)], most if most is not None else (1 << 31) - 1)


def dense(vectors: DataFrame, queries: DataFrame, most: int | None, doc_id: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score, rank): vectors ranked for each query vector by cosine similarity.

    Both sides have columns vector and version; only vectors of the query's version and dimension are compared, and vectors
    that are empty or not finite are left out. Queries are a stated set: they are broadcast in blocks, and vectors stay where they are.
    """
    own = vectors.filter(usable_vector(F.col("vector"))).select(doc_id, "version", F.size("vector").alias("dim"), "vector", norm(F.col("vector")).alias("length"))
    asked = queries.filter(usable_vector(F.col("vector"))).select(query_id, "version", F.size("vector").alias("dim"), F.col("vector").alias("asked"), norm(F.col("vector")).alias("asked_length"))
    score = F.round(dot(F.col("vector"), F.col("asked")) / ((F.col("length") + 1e-10) * (F.col("asked_length") + 1e-10)), DIGITS)
    n_blocks, found = max(1, -(-asked.count() // QUERY_BLOCK)), None
    for k in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64(query_id), F.lit(n_blocks)) == k)
        more = own.join(F.broadcast(block), ["version", "dim"]).select(query_id, doc_id, score.alias("score"))
        more = ranked(more, query_id, doc_id, most).drop("rank") if n_blocks > 1 else more
        found = more if found is None else found.unionByName(more)
    return ranked(found, query_id, doc_id, most)


def staleness(vectors: DataFrame, version: str, dim: int) -> DataFrame:
    """How many vectors can be used with a version and dimension, by version and dimension of the vectors."""
    usable = F.coalesce(usable_vector(F.col("vector")) & (F.col("version").cast("string") == version) & (F.size("vector") == dim), F.lit(False))
    return vectors.groupBy("version", F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.count_if(usable).alias("ready"))


def expanded(queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, variant, text): the query; with path and title in front where it lacks the title; title with the first six requirements."""
    title, text = text_of(F.col("title")), text_of(F.col("text"))
    second = F.when((title != "") & ~F.contains(text, title), F.substring(F.concat_ws(" ", F.trim(F.concat_ws(" ", "path", title)), text), 1, QUERY_CHARS))
    wanted = F.array_join(F.slice(F.coalesce("requirements", F.array().cast("array<string>")), 1, 6), " ")
    third = F.when(wanted != "", F.substring(F.concat_ws(" ", title, wanted), 1, QUERY_CHARS))
    return queries.select(query_id, F.posexplode(F.array(text, second, third)).alias("variant", "text")).filter(F.col("text").isNotNull())


def filtered_after_cut(ranking: DataFrame, allowed: DataFrame, most: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """The first `most` of the allowed documents among the first 3 * most of a ranking: the filter stays above the cut."""
    cut = ranking.filter(F.col("rank") <= 3 * most).join(allowed.select(doc_id).distinct(), doc_id, "left_semi")
    return first_rows(cut.drop("rank"), [query_id], [F.desc("score"), F.asc(doc_id)], most)


def fuse(lists: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, score) by reciprocal rank fusion of rows with channel and rank."""
    rows = fused(lists, [query_id], doc_id, FUSION_K)
    return rows.select(query_id, doc_id, F.round("score", 8).alias("score"))


def pick(fused_rows: DataFrame, most: int, excluded: DataFrame | None = None, pins: DataFrame | None = None, scores: DataFrame | None = None, threshold: float = 6.0, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, score, rerank, pinned, rank): what is handed on of fused rankings.

    Excluded pairs go first. With scores (doc_id, rerank and, if it depends on it, query_id) from an injected scorer, the
    first max(4 * most, 12) candidates are judged: those of at least the threshold stay, and pins that are not among them have
    score 10. Queries for which nothing was scored, and all without scores, keep the fused order, with missing pins in front
    by identifier. Then `most` stay, so a pin that was scored but is not among them goes.
    """
    keys = [query_id, doc_id]
    if excluded is not None:
        fused_rows = fused_rows.join(excluded.select(*keys).distinct(), keys, "left_anti")
        pins = pins.join(excluded.select(*keys).distinct(), keys, "left_anti") if pins is not None else None
    candidates = first_rows(fused_rows, [query_id], [F.desc("score"), F.asc(doc_id)], max(4 * most, 12), "place")
    pinned = pins.select(*keys).distinct().withColumn("pinned", F.lit(True)) if pins is not None else fused_rows.select(*keys).limit(0).withColumn("pinned", F.lit(True))
    candidates = candidates.join(scores, [k for k in keys if k in scores.columns], "left") if scores is not None else candidates.withColumn("rerank", F.lit(None).cast("double"))
    judged = candidates.filter(F.col("rerank").isNotNull()).select(query_id).distinct().withColumn("judged", F.lit(True))
    best = candidates.join(judged, query_id, "left")
    kept = best.filter(F.when(F.col("judged"), F.coalesce(F.col("rerank") >= threshold, F.lit(False))).otherwise(F.col("place") <= most))
    everything = kept.join(pinned, keys, "full").join(judged.withColumnRenamed("judged", "query_judged"), query_id, "left")
    by_rerank = F.coalesce("query_judged", F.lit(False))
    order = F.when(by_rerank, F.coalesce("rerank", F.lit(PINNED_SCORE))).otherwise(F.when(F.col("place").isNull(), 1e9).otherwise(-F.col("place")))
    rows = everything.select(*keys, "score", F.when(by_rerank, F.coalesce("rerank", F.lit(PINNED_SCORE))).alias("rerank"), F.coalesce("pinned", F.lit(False)).alias("pinned"), order.alias("order"))
    return first_rows(rows, [query_id], [F.desc("order"), F.desc_nulls_last("score"), F.asc(doc_id)], most).drop("order")


def retrieve(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, most: int = 5, recall: int = 20, excluded: DataFrame | None = None, pins: DataFrame | None = None, scores: DataFrame | None = None, threshold: float = 6.0, doc_id: str = "doc_id") -> DataFrame:
    """Hybrid retrieval for all queries: both rankings, fusion, and `pick`, with each stage's score beside the result."""
    pins = pins.join(docs.select(doc_id), doc_id, "left_semi") if pins is not None else None
    words = bm25(docs, queries, recall, doc_id)
    near = dense(vectors, query_vectors, recall, doc_id)
    lists = cut(words.withColumn("channel", F.lit("bm25")).unionByName(near.withColumn("channel", F.lit("dense"))), "lists")  # a query's first rows, read twice
    picked = pick(fuse(lists, doc_id=doc_id), most, excluded, pins, scores, threshold, doc_id=doc_id)
    stages = lists.groupBy("query_id", doc_id).agg(F.max(F.when(F.col("channel") == "bm25", F.col("score"))).alias("bm25"), F.max(F.when(F.col("channel") == "dense", F.col("score"))).alias("dense"))
    return picked.join(stages, ["query_id", doc_id], "left").select("query_id", doc_id, "rank", F.col("score").alias("fused"), "bm25", "dense", "rerank", "pinned")


def stale_vectors(chunks: DataFrame, vectors: DataFrame, version: str) -> DataFrame:
    """Chunks without a usable vector of the version: those to embed again."""
    ready = vectors.filter((F.col("version").cast("string") == version) & usable_vector(F.col("vector"))).select("doc_id").distinct()
    return chunks.join(ready, "doc_id", "left_anti")
