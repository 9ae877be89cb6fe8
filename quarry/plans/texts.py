"""Text measurement, noise, marks and repeated lines over `documents`, `pages` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, numbers, text
from ..functions.text import BLANKS
from ..operators import lines
from ..sources.tables import paragraphs, table
from .registry import query

LINES = "p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents)"
STRIPPED = rf"regexp_replace(line, '\A[{BLANKS}]+|[{BLANKS}]+\z', '', 'g')"
SQL_FENCE, SQL_DIAGRAM = r"(?s)```.*?(?:```|\z)", r"(?s)```mermaid\b.*?(?:```|\z)"


@query(rf"""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[{BLANKS}]+', '', 'g')) AS chars,
length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{SQL_FENCE}', '', 'g'),
  '{text.TABLE_RULE}', '', 'g'), '{text.BULLET}', '', 'g'), '{text.MARKUP}', '', 'g'), '[{BLANKS}]+', '', 'g')) AS body_chars,
length(regexp_replace(array_to_string(regexp_extract_all(coalesce(text, ''), '{SQL_DIAGRAM}'), ''), '[{BLANKS}]+', '', 'g')) AS diagram_chars
FROM documents""")
def text_sizes(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.chars(t).alias("chars"), text.body_chars(t).alias("body_chars"), text.diagram_chars(t).alias("diagram_chars"))


@query(rf"SELECT doc_id, substr(md5(regexp_replace(coalesce(text, ''), '[{BLANKS}]+', '', 'g')), 1, 16) AS fingerprint FROM documents")
def text_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.text_fingerprint(F.col("text")).alias("fingerprint"))


@query(rf"""SELECT doc_id, length(text) AS total, least(200, length(text)) AS "start", least(least(200, length(text)) + 300, length(text)) AS "end",
least(least(200, length(text)) + 300, length(text)) < length(text) AS truncated, substr(text, least(200, length(text)) + 1, 300) AS page,
substr(regexp_replace(regexp_replace(text, '[{BLANKS}]+', ' ', 'g'), '\A[{BLANKS}]+|[{BLANKS}]+\z', '', 'g'), 1, 80) AS preview FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def text_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.page_of(F.col("text"), 200, 300).alias("p"), text.preview(F.col("text")).alias("preview"))
    return rows.select("doc_id", "p.*", "preview")


@query(f"""WITH {LINES}, s AS (SELECT doc_id, pos, line, {STRIPPED} AS t FROM p),
k AS (SELECT doc_id, pos, line, regexp_replace(t, '[{BLANKS}]+', '', 'g') AS n FROM s
  WHERE t != '' AND NOT regexp_matches(t, '{text.PAGE_NUMBER}') AND NOT (regexp_matches(t, '{text.CONTENTS_LINE}') AND length(t) < 90)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY pos) AS rn FROM k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM r WHERE length(n) > 40 OR rn <= 3 GROUP BY doc_id""")
def noise_lines(spark, sf_dir):
    kept = lines.kept_lines(table(spark, sf_dir, "documents")).filter(F.size("kept") > 0)
    return kept.select("doc_id", F.size("kept").cast("long").alias("n_lines"), F.aggregate("kept", F.lit(0).cast("long"), lambda n, x: n + F.length(x["line"])).alias("n_chars"))


@query(f"""WITH {LINES} SELECT doc_id, line, count(*) AS n FROM p WHERE regexp_replace(line, '[{BLANKS}]+', '', 'g') != '' GROUP BY ALL HAVING count(*) > 1""")
def repeated_lines(spark, sf_dir):
    return lines.repeated(paragraphs(spark, sf_dir))


@query(f"""WITH {LINES}, n AS (SELECT DISTINCT doc_id, regexp_replace(line, '[{BLANKS}]+', '', 'g') AS k FROM p), src AS (SELECT doc_id, coalesce(source, '') AS source FROM documents),
c AS (SELECT source, k, count(DISTINCT doc_id) AS docs FROM n JOIN src USING (doc_id) WHERE k != '' AND length(k) <= 40 GROUP BY ALL), t AS (SELECT source, count(DISTINCT doc_id) AS total FROM src GROUP BY ALL)
SELECT source, k AS line, docs FROM c JOIN t USING (source) WHERE docs >= greatest(2, CAST(ceil(0.02 * total) AS BIGINT))""")
def page_furniture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    return lines.furniture(docs, "source", share=0.02)


@query(f"""WITH t AS (SELECT page_id, coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title FROM pages),
k AS (SELECT page_id, title, lower(regexp_replace(title, '[{BLANKS}]+', '', 'g')) AS key FROM t)
, f AS (SELECT key, min(page_id) AS page_id, arg_min(title, page_id) AS title FROM k GROUP BY key)
SELECT DISTINCT f.key, f.page_id, f.title, k.page_id AS member FROM k JOIN f USING (key)""")
def title_dedupe(spark, sf_dir):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return lines.merged_titles(table(spark, sf_dir, "pages").select("page_id", F.coalesce(title, F.lit("")).alias("title")), "title", "page_id", "member")


TAG_WORDS = {"the": ["english", "common"], "elle": ["french"], "der": ["german", "common"], "ción": ["spanish"]}


@query("""WITH r(word, tags) AS (VALUES ('the', ['english', 'common']), ('elle', ['french']), ('der', ['german', 'common']), ('ción', ['spanish'])),
f AS (SELECT doc_id, unnest(tags) AS tag FROM documents JOIN r ON contains(coalesce(source, ''), word) OR contains(substr(coalesce(text, ''), 1, 120), word)),
g AS (SELECT doc_id, list_sort(list(DISTINCT tag)) AS tags FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(tags, []) AS tags FROM documents LEFT JOIN g USING (doc_id)""")
def line_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tags(F.col("source"), F.substring("text", 1, 120), TAG_WORDS).alias("tags"))


MARKED = "concat('前言【工期：待核实】', coalesce(text, ''), '众所周知，大概【待填写：', source, '】可能')"
CLICHES = " + ".join(f"len(regexp_extract_all(t, '{c}'))" for c in text.CLICHES)


@query(f"""WITH m AS (SELECT doc_id, replace({MARKED}, chr(10), ' ') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '{text.PLACEHOLDER}')) AS placeholders, len(regexp_extract_all(t, '{text.VERIFY_MARK}')) AS to_verify, {CLICHES} AS cliches,
  CAST(contains(t, '大概') AS INT) + CAST(contains(t, '可能') AS INT) AS weak, replace(replace(t, '众所周知，', ''), '众所周知', '') AS polished FROM m""")
def marks(spark, sf_dir):
    """Marks in whole texts, with some put around each."""
    return counted_marks(spark, sf_dir, text.text_of(F.col("text")))


def counted_marks(spark, sf_dir, body):
    t = F.translate(F.concat(F.lit("前言【工期：待核实】"), body, F.lit("众所周知，大概【待填写："), F.coalesce("source", F.lit("")), F.lit("】可能")), "\n", " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return rows.select(
        "doc_id", F.size(text.placeholders(F.col("t"))).alias("placeholders"), F.regexp_count("t", F.lit(text.VERIFY_MARK)).alias("to_verify"),
        text.cliche_hits(F.col("t")).alias("cliches"), F.size(text.weak_phrases(F.col("t"))).alias("weak"), text.polished(F.col("t")).alias("polished"),
    )


@query(f"""WITH m AS (SELECT doc_id, replace({MARKED}, chr(10), ' ') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '{text.PLACEHOLDER}')) AS placeholders, len(regexp_extract_all(t, '{text.VERIFY_MARK}')) AS to_verify FROM m""")
def marks_whole(spark, sf_dir):
    """The bracketed marks alone, in whole texts."""
    return marks(spark, sf_dir).select("doc_id", "placeholders", "to_verify")


@query("SELECT p_partkey, p_name AS name, CAST(p_size AS DOUBLE) AS points, p_brand AS category, CAST(p_size AS DOUBLE) AS weight FROM part")
def points_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "part").select("p_partkey", numbers.points_cell(F.concat("p_name", F.lit(" （"), "p_size", F.lit("分）"))).alias("c"), numbers.category_weight(F.concat("p_brand", F.lit(" "), "p_size", F.lit("%"))).alias("w"))
    return cells.select("p_partkey", F.col("c.name"), F.col("c.points"), F.col("w.name").alias("category"), F.col("w.weight"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS full_date, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders""")
def parsed_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    full = F.concat(F.year(d), F.lit("年"), F.month(d), F.lit("月"), F.dayofmonth(d), F.lit("日"))
    month = F.concat(F.lit("至 "), F.year(d), F.lit("."), F.month(d))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_date(full).alias("full_date"), numbers.parse_date(month, month_end=True).alias("month_end"))


@query("SELECT user_id AS run_id, sha256(concat(length(CAST(user_id AS VARCHAR)), ':', user_id, '|', length(event_type), ':', event_type, '|-')) AS sha, event_id FROM events")
def fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.col("user_id").alias("run_id"), hashing.fingerprint(F.col("user_id"), F.col("event_type"), F.lit(None).cast("string")).alias("sha"))
