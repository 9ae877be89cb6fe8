"""Retrieval over `documents` (passages), `benchmark` (queries) and `embeddings` (vectors; label is the version)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval
from ..sources.tables import table
from .registry import query

WORDS = """dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS words FROM documents),
qw AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM benchmark),
asked AS (SELECT query_id, term, count(*) AS asked FROM qw GROUP BY ALL),
tf AS (SELECT doc_id, len(words) AS size, unnest(words) AS term FROM dw),
counts AS (SELECT doc_id, size, term, count(*) AS tf FROM tf GROUP BY ALL),
sizes AS (SELECT count(*) AS n, avg(len(words)) AS mean_size FROM dw),
idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf, any_value(mean_size) AS mean_size FROM counts, sizes GROUP BY term, n),
w AS (SELECT term, mean_size, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS idf FROM idf),
bm AS (SELECT query_id, doc_id, round(sum(asked * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * size / mean_size))), 6) AS score FROM counts JOIN asked USING (term) JOIN w USING (term) GROUP BY ALL),
bm_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm),
"""
VECTORS = """v AS (SELECT vec_id AS doc_id, label AS version, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings),
q AS (SELECT item_id AS query_id, version, vector FROM benchmark JOIN v ON v.doc_id = item_id),
near AS (SELECT query_id, doc_id, round(list_inner_product(v.vector, q.vector) / ((sqrt(list_inner_product(v.vector, v.vector)) + 1e-10) * (sqrt(list_inner_product(q.vector, q.vector)) + 1e-10)), 6) AS score FROM v JOIN q USING (version)),
near_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near)
"""
FUSED = """, lists AS (SELECT * FROM bm_r WHERE rank <= 20 UNION ALL SELECT * FROM near_r WHERE rank <= 20),
fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM lists GROUP BY ALL),
"""


def passages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("version"), F.col("embedding").alias("vector"))


def query_vectors(spark, sf_dir):
    own = vectors(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "version", "vector")
    return own.join(queries(spark, sf_dir).select("query_id"), "query_id", "left_semi")


@query("WITH " + WORDS.rstrip().rstrip(",") + " SELECT query_id, doc_id, score, rank FROM bm_r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(passages(spark, sf_dir), queries(spark, sf_dir), 10)


@query("WITH " + VECTORS + "SELECT query_id, doc_id, score, rank FROM near_r WHERE rank <= 20")
def dense_topk(spark, sf_dir):
    return retrieval.dense(vectors(spark, sf_dir), query_vectors(spark, sf_dir), 20)


@query("WITH " + WORDS + VECTORS + FUSED.rstrip().rstrip(",") + " SELECT query_id, doc_id, score FROM fused")
def rrf_fused(spark, sf_dir):
    words = retrieval.bm25(passages(spark, sf_dir), queries(spark, sf_dir), 20).withColumn("channel", F.lit("bm25"))
    near = retrieval.dense(vectors(spark, sf_dir), query_vectors(spark, sf_dir), 20).withColumn("channel", F.lit("dense"))
    return retrieval.fuse(words.unionByName(near))


STAGES = "st AS (SELECT query_id, doc_id, max(s) AS bm25, max(d) AS dense FROM (SELECT query_id, doc_id, score AS s, NULL::DOUBLE AS d FROM bm_r WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, NULL, score FROM near_r WHERE rank <= 20) GROUP BY ALL)"


@query("WITH " + WORDS + VECTORS + FUSED + STAGES + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)
SELECT r.query_id, r.doc_id, rank, score AS fused, bm25, dense, CAST(NULL AS DOUBLE) AS rerank, false AS pinned FROM r LEFT JOIN st USING (query_id, doc_id) WHERE rank <= 5""")
def retrieve(spark, sf_dir):
    """The flagship: hybrid retrieval of passages for every query, without an injected scorer."""
    return retrieval.retrieve(passages(spark, sf_dir), vectors(spark, sf_dir), queries(spark, sf_dir), query_vectors(spark, sf_dir))


@query("WITH " + WORDS + VECTORS + FUSED + STAGES + """, ok AS (SELECT * FROM fused WHERE doc_id != query_id + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM ok),
s AS (SELECT r.*, 10.0 * quality - 5.0 * toxic AS rerank FROM r LEFT JOIN labels USING (doc_id) WHERE place <= 20),
j AS (SELECT DISTINCT query_id FROM s WHERE rerank IS NOT NULL),
kept AS (SELECT s.* FROM s LEFT JOIN j USING (query_id) WHERE CASE WHEN j.query_id IS NOT NULL THEN coalesce(rerank >= 6, false) ELSE place <= 5 END),
pins AS (SELECT item_id AS query_id, item_id AS doc_id FROM benchmark),
e AS (SELECT coalesce(kept.query_id, pins.query_id) AS query_id, coalesce(kept.doc_id, pins.doc_id) AS doc_id, score, place, rerank, pins.doc_id IS NOT NULL AS pinned FROM kept FULL JOIN pins ON kept.query_id = pins.query_id AND kept.doc_id = pins.doc_id),
f AS (SELECT e.*, j.query_id IS NOT NULL AS judged FROM e LEFT JOIN j USING (query_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN judged THEN coalesce(rerank, 10.0) WHEN place IS NULL THEN 1e9 ELSE -place END DESC, score DESC NULLS LAST, doc_id) AS rank FROM f)
SELECT o.query_id, o.doc_id, rank, score AS fused, bm25, dense, CASE WHEN judged THEN coalesce(rerank, 10.0) END AS rerank, pinned FROM o LEFT JOIN st ON st.query_id = o.query_id AND st.doc_id = o.doc_id WHERE rank <= 5""")
def retrieve_pinned(spark, sf_dir):
    """With an injected score (from labels, null where a document has none), a pin and an exclusion for every query."""
    asked = queries(spark, sf_dir)
    pins = asked.select("query_id", F.col("query_id").alias("doc_id"))
    excluded = asked.select("query_id", (F.col("query_id") + 1).alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (10.0 * F.col("quality") - 5.0 * F.col("toxic")).alias("rerank"))
    return retrieval.retrieve(passages(spark, sf_dir), vectors(spark, sf_dir), asked, query_vectors(spark, sf_dir), excluded=excluded, pins=pins, scores=labels)
