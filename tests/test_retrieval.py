"""BM25 over documents that are scored where their postings meet."""

import re

from quarry.operators import retrieval


def ranked(spark, docs, queries):
    return {(r.query_id, r.doc_id): (r.score, r.rank) for r in retrieval.bm25(docs, queries, 3).collect()}


def test_bm25_scores_documents_in_one_task(spark, monkeypatch):
    """Pairs of queries and documents are not shuffled before they are ranked, and tasks grow in number with the pairs."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 13}" for j in range(1, 12))) for k in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"w{q} w{q + 1} w0 w0") for q in range(5)], "query_id long, text string")
    whole = ranked(spark, docs, queries)
    assert len(whole) == 15
    monkeypatch.setattr(retrieval, "PAIRS", 20)
    assert ranked(spark, docs, queries) == whole
    plan = retrieval.bm25(docs, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L, doc_id#", plan)
    assert re.search(r"hashpartitioning\(doc_id#\d+L, 10\), REPARTITION_BY_NUM", plan)
