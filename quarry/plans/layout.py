"""Pages laid out from lines of documents: measures of pages and paragraphs; texts with addenda; writes of sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, pieces
from ..sources.tables import paragraphs, table
from ..streaming import writes
from .registry import query

# Twenty lines a page; short lines are set larger, every fifth length is indented, lines with bars stand in tables.
LINES = """l AS (SELECT doc_id, CAST(p // 20 AS INT) AS page, CAST(p % 20 AS INT) AS pos, CASE WHEN length(t) % 5 = 0 THEN 92.0 ELSE 71.0 END AS x0, p % 20 * (20.0 + p // 20 % 3) + 50 AS y0, least(524.0, 71 + length(t) * 4.0) AS x1,
p % 20 * (20.0 + p // 20 % 3) + 60.5 AS y1, CASE WHEN length(t) < 15 THEN 14.0 ELSE 10.5 END AS size, t AS text, contains(t, '|') AS in_table FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS p FROM documents))"""


def page_lines(spark, sf_dir):
    rows, n, p = paragraphs(spark, sf_dir), F.length("line"), F.col("pos")
    place = p % 20
    top = place * (20.0 + F.floor(p / 20) % 3) + 50
    return rows.select(
        "doc_id", F.floor(p / 20).cast("int").alias("page"), place.alias("pos"), F.when(n % 5 == 0, 92.0).otherwise(71.0).alias("x0"), top.alias("y0"), F.least(F.lit(524.0), 71 + n * 4.0).alias("x1"), (top + 10.5).alias("y1"),
        F.when(n < 15, 14.0).otherwise(10.5).alias("size"), (n < 15).alias("bold"), F.col("line").alias("text"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.contains("line", F.lit("|")).alias("in_table"),
    )


EDGE = "SELECT {0}, max(CASE WHEN here >= greatest(3.0, n * {1}) THEN x1 END) AS edge, max(n) AS n, max(x1) AS last FROM (SELECT *, count(*) OVER (PARTITION BY {0}) AS n, count(*) OVER (PARTITION BY {0} ORDER BY CAST(round(x1 / body * 1000000) AS BIGINT) RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) AS here FROM long) GROUP BY {0}"


@query(f"""WITH {LINES}, s AS (SELECT doc_id, size, sum(length(text)) AS n, min(page * 100 + pos) AS first FROM l GROUP BY ALL), b AS (SELECT doc_id, size AS body FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1),
o AS (SELECT l.*, body FROM l JOIN b USING (doc_id) WHERE abs(size - body) <= 1 AND NOT in_table), d AS (SELECT *, y0 - lag(y1) OVER w AS space, lag(x1) OVER w AS before FROM o WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)),
g AS (SELECT doc_id, page, round_even(space, 0) AS gap, page * 100 + pos AS spot FROM d WHERE space >= 0 AND space <= 3 * body AND x0 < before),
gc AS (SELECT doc_id, page, gap, count(*) AS n, min(spot) AS first FROM g GROUP BY ALL), gx AS (SELECT doc_id, gap, sum(n) AS n, min(first) AS first FROM gc GROUP BY ALL),
gp AS (SELECT doc_id, page, gap AS page_gap, sum(n) OVER (PARTITION BY doc_id, page) AS samples FROM gc QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, first) = 1),
gd AS (SELECT doc_id, gap AS doc_gap FROM gx QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1),
xc AS (SELECT doc_id, round_even(x0, 0) AS x, count(*) AS n FROM o GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM xc), m AS (SELECT doc_id, coalesce(min(x) FILTER (n >= greatest(3.0, total * 0.05)), min(x)) AS margin FROM x GROUP BY doc_id),
long AS (SELECT * FROM o WHERE length(text) >= 10 AND x1 > 297.5), r AS ({EDGE.format("doc_id", 0.2)}), e AS ({EDGE.format("doc_id, page", 0.25)}), p AS (SELECT DISTINCT doc_id, page FROM l),
j AS (SELECT p.doc_id, p.page, body, CAST(coalesce(CASE WHEN samples >= 5 THEN page_gap END, doc_gap, 0) AS DOUBLE) AS gap, coalesce(margin, 0.0) AS margin, coalesce(r.edge, r.last, 595.0) AS right, CASE WHEN e.n >= 6 THEN e.edge END AS own
FROM p JOIN b USING (doc_id) LEFT JOIN gp USING (doc_id, page) LEFT JOIN gd USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN e USING (doc_id, page))
SELECT doc_id, page, CAST(body AS DOUBLE) AS body, gap, CAST(margin AS DOUBLE) AS margin, CAST(CASE WHEN own >= "right" - 3 * body THEN own ELSE "right" END AS DOUBLE) AS "right" FROM j""")
def page_measures(spark, sf_dir):
    return layout.page_measures(page_lines(spark, sf_dir))


@query()
def layout_paragraphs(spark, sf_dir):
    """Lines of whole documents as paragraphs; rules and measures are tested one by one."""
    return layout.paragraphs(page_lines(spark, sf_dir))


# Addenda: words replaced, one of them revoked; no word overlaps another.
CHANGES = [(1, "the", "THE"), (2, "und", "& so on"), (3, "que", ""), (4, "les", "L")]
REPLACED = "text"
for _, _old, _new in CHANGES:
    REPLACED = f"replace({REPLACED}, '{_old}', '{_new or pieces.REVOKED}')"


def changed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, spark.createDataFrame(CHANGES, "change_id int, original string, text string")


@query(f"SELECT doc_id, {REPLACED} AS text FROM documents")
def effective_texts(spark, sf_dir):
    docs, changes = changed(spark, sf_dir)
    return pieces.text_now(pieces.pieces_of(docs, changes), docs)


@query("SELECT doc_id, replace(replace(text, 'the', 'THE'), 'les', 'L') AS text FROM documents")
def texts_without_withdrawn(spark, sf_dir):
    """Two of the four changes are withdrawn from the pieces."""
    docs, changes = changed(spark, sf_dir)
    return pieces.text_now(pieces.withdrawn(pieces.pieces_of(docs, changes), changes.filter("change_id IN (2, 3)")), docs)


@query("""SELECT doc_id, length(text) - 1 AS place, CASE WHEN right(text, 3) NOT IN ('the', 'und', 'que', 'les') AND NOT regexp_matches(text, '(the|und|que|les)$') THEN CAST(length(""" + REPLACED + """) - 1 AS BIGINT) END AS now FROM documents WHERE text != ''""")
def moved_ends(spark, sf_dir):
    """Where the last character of each text stands once changes are made; none if a change took it."""
    docs, changes = changed(spark, sf_dir)
    ends = docs.filter("text != ''").select("doc_id", (F.length("text") - 1).cast("long").alias("place"))
    return pieces.to_new(ends, pieces.pieces_of(docs, changes)).select("doc_id", "place", "now")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id % 10 = 0 AS stale FROM events), a AS (SELECT *, coalesce(lag(event_type) OVER w != event_type, true) AS fresh FROM e WHERE NOT stale WINDOW w AS (PARTITION BY user_id ORDER BY k)),
b AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY k) AS revision, CASE WHEN NOT fresh AND event_type = 'purchase' THEN 'reviewed' ELSE 'completed' END AS status, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY k), '') AS old FROM a)
SELECT user_id AS section_id, event_id AS write_id, 'written' AS outcome, status, CAST(revision AS BIGINT) AS revision, CAST(CASE WHEN status = 'reviewed' THEN revision END AS BIGINT) AS reviewed, CASE WHEN event_type = 'view' THEN old END AS replaced FROM b
UNION ALL SELECT e.user_id, e.event_id, 'refused', coalesce(b.status, 'pending'), coalesce(CAST(b.revision AS BIGINT), 0), CAST(CASE WHEN b.status = 'reviewed' THEN b.revision END AS BIGINT), NULL FROM (SELECT * FROM e WHERE stale) e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.k >= b.k""")
def section_writes(spark, sf_dir):
    """Events as writes of their users' sections; every tenth was made for a revision that never is."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("section_id"), F.col("ts").alias("at"), F.col("event_id").alias("write_id"), kind.alias("content"), F.when(kind == "purchase", "reviewed").otherwise("completed").alias("status"),
        F.when(kind == "view", "polish").alias("version_source"), F.lit(None).cast("string").alias("expect_content"), F.when(F.col("event_id") % 10 == 0, -1).cast("long").alias("expected_revision"), F.lit(None).cast("string").alias("expected_status"),
    )
    return writes.section_writes(rows)
