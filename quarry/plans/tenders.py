"""Section trees, clauses and items to verify over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS
from ..operators import clauses, sections, verification
from ..sources.tables import table
from .registry import query

# Turns of conversations as lines of a document: every third one is a heading, with a number in front and a level by its turn.
NUMBERED = "concat(CASE (turn // 3) % 4 WHEN 0 THEN '第一章 ' WHEN 1 THEN '1.2 ' WHEN 2 THEN '1.2.3 ' ELSE '（二）' END, role)"
HEADINGS = f"SELECT conv_id AS doc_id, turn AS pos, CAST((turn * 7 + conv_id) % 4 + 1 AS INT) AS level, {NUMBERED} AS title FROM conversations"


def headings(spark, sf_dir):
    form = F.element_at(F.array(*[F.lit(x) for x in ("第一章 ", "1.2 ", "1.2.3 ", "（二）")]), (F.floor(F.col("turn") / 3) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), ((F.col("turn") * 7 + F.col("conv_id")) % 4 + 1).cast("int").alias("level"), F.concat(form, "role").alias("title"))


@query(f"""WITH h AS ({HEADINGS}), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS section FROM h),
a AS (SELECT doc_id, section, level FROM n UNION ALL SELECT DISTINCT doc_id, -1, 1 FROM n)
SELECT doc_id, section, pos, level, title, (SELECT max(a.section) FROM a WHERE a.doc_id = n.doc_id AND a.section < n.section AND a.level < n.level AND NOT (a.section = -1 AND EXISTS (SELECT 1 FROM n x WHERE x.doc_id = n.doc_id AND x.section < n.section AND x.level = 1))) AS parent FROM n""")
def section_tree(spark, sf_dir):
    return sections.section_tree(headings(spark, sf_dir)).drop("path")


@query(f"""WITH RECURSIVE h AS ({HEADINGS}), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS section FROM h),
p AS (SELECT doc_id, section, title, level, (SELECT max(a.section) FROM n a WHERE a.doc_id = n.doc_id AND a.section < n.section AND a.level < n.level) AS parent FROM n),
r AS (SELECT doc_id, section, title AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.section, concat(r.path, ' > ', p.title) FROM p JOIN r ON p.doc_id = r.doc_id AND p.parent = r.section) SELECT * FROM r""")
def section_paths(spark, sf_dir):
    return sections.section_tree(headings(spark, sf_dir)).select("doc_id", "section", "path")


@query(f"""WITH h AS ({HEADINGS}), c AS (SELECT doc_id, level, CASE WHEN title LIKE '第%' THEN 'part' WHEN title LIKE '（%' THEN 'cn_paren' WHEN title LIKE '1.2.3%' THEN 'num3' ELSE 'num2' END AS numbering FROM h),
v AS (SELECT doc_id, numbering, level, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, numbering) AS total FROM v)
SELECT doc_id, numbering, level FROM b WHERE total >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, numbering ORDER BY n DESC, level) = 1""")
def majority_levels(spark, sf_dir):
    return sections.majority_levels(headings(spark, sf_dir))


LINES = "SELECT doc_id, pos, unnest(line) AS line FROM (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos, string_split(coalesce(text, ''), chr(10)) AS line FROM documents)"
LEVELLED = "concat(CASE turn % 6 WHEN 0 THEN '第三章 ' WHEN 1 THEN '（四） ' WHEN 2 THEN '2.10.1 ' WHEN 3 THEN '12) ' WHEN 4 THEN '2024 年 ' ELSE '' END, said, CASE WHEN turn % 5 = 0 THEN '；' ELSE '' END)"
SAID = "(SELECT * EXCLUDE (parts), unnest(parts) AS said, generate_subscripts(parts, 1) - 1 AS pos FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '[.\n]') AS parts FROM conversations))"


@query(f"""WITH l AS (SELECT conv_id, turn, pos, regexp_replace({LEVELLED}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g') AS t FROM {SAID})
SELECT conv_id, turn, CAST(pos AS INT) AS pos, CASE WHEN length(t) < 2 OR length(t) > 60 OR regexp_matches(t, '[，,；;、]$|^(?:19|20)[0-9]{{2}}[ ]*年|^[0-9]+[ ]*(?:万|千|亿|元|个|条|家|台|套)') THEN NULL
WHEN regexp_matches(t, '^(?:[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{1,2}}|[0-9]{{1,2}}[）)]|[（(][0-9]{{1,2}}[）)])') THEN 3 WHEN regexp_matches(t, '^(?:[0-9]{{1,2}}\\.[0-9]{{1,2}}|[（(][一二三四五六七八九十]+[）)])') THEN 2
WHEN regexp_matches(t, '^(?:第[一二三四五六七八九十百0-9]+[章节篇部]|[一二三四五六七八九十]+[、.．]|[0-9]{{1,2}}[ ]+[\\p{{L}}_]|[0-9]{{1,2}}[、.．])') THEN 1 END AS level FROM l""")
def heading_levels(spark, sf_dir):
    form = F.element_at(F.array(*[F.lit(x) for x in ("第三章 ", "（四） ", "2.10.1 ", "12) ", "2024 年 ", "")]), (F.col("turn") % 6 + 1).cast("int"))
    line = F.concat(form, "said", F.when(F.col("turn") % 5 == 0, "；").otherwise(""))
    return sentences(spark, sf_dir).select("conv_id", "turn", "pos", sections.heading_level(line).alias("level"))


def sentences(spark, sf_dir):
    """Turns of conversations cut at stops and line ends: conv_id, turn, pos, said."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.\n]")).alias("pos", "said"))


KINDS = "CASE WHEN turn % 7 = 3 THEN 'heading' WHEN turn % 3 = 1 THEN 'table' ELSE 'paragraph' END"


@query(f"""WITH r AS (SELECT conv_id AS doc_id, turn AS pos, {KINDS} AS kind, text FROM conversations), s AS (SELECT *, sum(CAST(kind = 'heading' AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM r)
SELECT doc_id, pos, coalesce((SELECT string_agg(text, chr(10) ORDER BY pos) FROM (SELECT b.pos, b.text FROM s b WHERE b.doc_id = a.doc_id AND b.k = a.k AND b.pos < a.pos AND b.kind = 'paragraph' ORDER BY b.pos DESC LIMIT 3)), '') AS context FROM s a WHERE kind = 'table'""")
def before_tables(spark, sf_dir):
    kind = F.when(F.col("turn") % 7 == 3, "heading").when(F.col("turn") % 3 == 1, "table").otherwise("paragraph")
    return sections.before_tables(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), kind.alias("kind"), "text"))


@query("""SELECT o_orderkey, concat('| key | status | note |', chr(10), '| --- | --- | --- |', chr(10), '| ', o_orderkey, ' | ', o_orderstatus, ' | ', CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, ' |') AS markdown FROM orders""")
def table_markdown(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    second = F.when(F.col("o_orderkey") % 2 == 0, F.array(key, "o_orderstatus", "o_orderpriority", F.lit("cut"))).otherwise(F.array(key, "o_orderstatus"))
    grid = F.array(F.array(F.lit("key"), F.lit("status"), F.lit("note")), second)
    return table(spark, sf_dir, "orders").select("o_orderkey", sections.table_markdown(grid).alias("markdown"))


@query("SELECT l_orderkey AS doc_id, l_suppkey % 2 AS page, l_linenumber AS pos, l_quantity - lag(l_quantity + 1) OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber) AS gap FROM (SELECT * EXCLUDE (l_linenumber), row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l_linenumber FROM lineitem)")
def line_gaps(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2).alias("page"), pos.alias("pos"), F.col("l_quantity").alias("top"), (F.col("l_quantity") + 1).alias("bottom"))
    return sections.line_gaps(rows).select("doc_id", "page", "pos", "gap")


@query("""WITH v AS (SELECT DISTINCT c_nationkey, round(c_acctbal, 2) AS x FROM customer), m AS (SELECT *, CASE WHEN coalesce(x - lag(x) OVER (PARTITION BY c_nationkey ORDER BY x), 1e9) > 300 THEN 1 ELSE 0 END AS fresh FROM v),
r AS (SELECT c_nationkey, x, sum(fresh) OVER (PARTITION BY c_nationkey ORDER BY x) AS cluster FROM m) SELECT c_nationkey, CAST(cluster AS BIGINT) AS cluster, round(avg(x), 6) AS center, count(*) AS n FROM r GROUP BY ALL""")
def edge_clusters(spark, sf_dir):
    return sections.edge_clusters(table(spark, sf_dir, "customer").select("c_nationkey", F.round("c_acctbal", 2).alias("x")).distinct(), ["c_nationkey"], "x", 300.0)


@query("""WITH r AS (SELECT user_id, event_id AS pos, CASE WHEN event_type IN ('signup', 'purchase') THEN 'add' ELSE 'same' END AS type FROM events), k AS (SELECT *, sum(CAST(type != 'same' AS INT)) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM r),
n AS (SELECT *, count(*) OVER o AS n, row_number() OVER (o ORDER BY pos) AS i, max(run) OVER (PARTITION BY user_id) AS last FROM k WINDOW o AS (PARTITION BY user_id, run, type = 'same')),
h AS (SELECT *, CASE WHEN run = 0 THEN 0 ELSE 2 END AS head, CASE WHEN run = last THEN 0 ELSE 2 END AS tail FROM n), c AS (SELECT *, type = 'same' AND n > head + tail + 1 AND i > head AND i <= n - tail AS gone FROM h)
SELECT user_id, pos, CASE WHEN gone THEN 'gap' ELSE type END AS type, CASE WHEN gone THEN n - head - tail END AS count FROM c WHERE NOT gone OR i = head + 1""")
def collapsed_diff(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "add").otherwise("same")
    return sections.collapsed(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), kind.alias("type")), ["user_id"])


@query(r"""WITH s AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN concat('## 1.1 ', role, chr(10), text) ELSE concat('**', role, ' extra**', chr(10), text) END AS said FROM conversations),
b AS (SELECT *, regexp_replace(said, '^\n+', '') AS b FROM s), f AS (SELECT *, split_part(b, chr(10), 1) AS head, regexp_replace(split_part(b, chr(10), 1), '[#*\s]', '', 'g') AS h FROM b),
k AS (SELECT *, regexp_replace(h, '^(?:第[一二三四五六七八九十百0-9]+[章节篇]|[0-9.]+|[一二三四五六七八九十]+[、.．])', '') AS heading FROM f)
SELECT conv_id, turn, said, CASE WHEN regexp_matches(head, '^\s*(?:#{1,6}\s*.+|\*\*.+\*\*)\s*$') AND heading != '' AND contains(heading, role) THEN regexp_replace(substr(b, length(head) + 2), '^\n+', '') ELSE said END AS body FROM k""")
def without_title(spark, sf_dir):
    turn = F.col("turn") % 3
    said = F.when(turn == 0, F.col("text")).when(turn == 1, F.concat(F.lit("## 1.1 "), "role", F.lit("\n"), "text")).otherwise(F.concat(F.lit("**"), "role", F.lit(" extra**\n"), "text"))
    rows = table(spark, sf_dir, "conversations").withColumn("said", said)
    return rows.select("conv_id", "turn", "said", sections.without_title(F.col("said"), F.concat(F.lit("第二章 "), "role")).alias("body"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 2 = 0 THEN 'the' ELSE 'de' END AS needle, CAST(doc_id % 4 AS INT) AS line FROM documents),
s AS (SELECT *, string_split(text, chr(10)) AS lines FROM t)
SELECT doc_id, CASE WHEN line > 0 AND line <= len(lines) AND contains(lines[line], needle) THEN length(array_to_string(lines[:line - 1], chr(10))) + CASE WHEN line > 1 THEN 1 ELSE 0 END + instr(lines[line], needle) - 1
  WHEN contains(text, needle) THEN instr(text, needle) - 1 END AS place FROM s""")
def excerpt_places(spark, sf_dir):
    excerpt = F.when(F.col("doc_id") % 2 == 0, "…the…").otherwise("…de")
    return table(spark, sf_dir, "documents").select("doc_id", sections.excerpt_place(F.coalesce("text", F.lit("")), excerpt, (F.col("doc_id") % 4).cast("int")).alias("place"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat_ws('; ', concat_ws(', ', concat(p_size, ' pages'), CASE WHEN p_partkey % 3 = 1 THEN 'sections by bookmarks' WHEN p_partkey % 2 = 0 THEN 'bookmarks do not fit, sections by layout' ELSE 'no bookmarks, sections by layout' END), p_name) END AS note FROM part""")
def source_notes(spark, sf_dir):
    n = F.col("p_partkey")
    note = sections.source_note(F.when(n % 3 == 0, "docx").otherwise("pdf"), F.col("p_size"), F.when(n % 3 == 1, "bookmarks").otherwise("layout"), n % 2 == 0, F.array("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", note.alias("note"))


# Lines of clauses: turns with marks and words of requirements in front.
CLAUSE = "concat(CASE turn % 5 WHEN 0 THEN '★' WHEN 1 THEN '1. ▲' WHEN 2 THEN '2、必须 ' WHEN 3 THEN '★标注 ' ELSE '' END, said, CASE WHEN turn % 4 = 0 THEN ' 应急' WHEN turn % 4 = 1 THEN ' 应当' ELSE '' END)"
CLAUSE_LINES = f"SELECT conv_id % 7 AS doc_id, (conv_id * 1000 + turn) * 100000 + pos AS pos, {CLAUSE} AS line FROM {SAID}"
TRIMMED = f"regexp_replace(line, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"
LEVEL = "CASE WHEN contains(line, '★') THEN 'redline' WHEN contains(line, '▲') THEN 'important' END"
OWN = f"l AS ({CLAUSE_LINES}), c AS (SELECT doc_id, pos, {TRIMMED} AS line FROM l), m AS (SELECT *, {LEVEL} AS level FROM c WHERE NOT contains(line, '标注'))"
REQUIREMENTS = f"""{OWN}, q AS (SELECT doc_id, pos, level, regexp_replace(line, '^[0-9]+[、.．{BLANKS}]+', '') AS clause FROM m WHERE line != '' AND (level IS NOT NULL OR (regexp_matches(line, '{clauses.LINE_WORDS}') AND length(line) BETWEEN 6 AND 300))),
f AS (SELECT *, substr(md5(regexp_replace(clause, '[{BLANKS}]+', '', 'g')), 1, 16) AS fingerprint FROM q), d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, fingerprint ORDER BY pos) = 1),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 60),
req AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE level WHEN 'redline' THEN 1 WHEN 'important' THEN 2 ELSE 3 END, pos) AS INT) AS index, coalesce(level, 'normal') AS level, clause, fingerprint FROM k)"""


def clause_lines(spark, sf_dir):
    turn = F.col("turn")
    front = F.when(turn % 5 == 0, "★").when(turn % 5 == 1, "1. ▲").when(turn % 5 == 2, "2、必须 ").when(turn % 5 == 3, "★标注 ").otherwise("")
    line = F.concat(front, "said", F.when(turn % 4 == 0, " 应急").when(turn % 4 == 1, " 应当").otherwise(""))
    place = (F.col("conv_id") * 1000 + turn) * 100_000 + F.col("pos")
    return sentences(spark, sf_dir).select((F.col("conv_id") % 7).alias("doc_id"), place.alias("pos"), line.alias("line"), clauses.usual_levels().alias("levels"))


@query(f"""WITH {OWN}, r AS (SELECT doc_id, level, row_number() OVER (PARTITION BY doc_id, level ORDER BY pos) AS number, line AS clause FROM m WHERE level IS NOT NULL AND length(line) > 4 AND length(line) < 200)
SELECT * FROM r WHERE number <= CASE WHEN level = 'redline' THEN 40 ELSE 60 END""")
def marked_clauses(spark, sf_dir):
    return clauses.marked_clauses(clause_lines(spark, sf_dir))


@query(f"WITH {REQUIREMENTS} SELECT * FROM req")
def requirement_lines(spark, sf_dir):
    return clauses.requirements(clause_lines(spark, sf_dir))


@query(f"""WITH {REQUIREMENTS}, k2 AS (SELECT doc_id, count_if({TRIMMED} != '' AND NOT contains(line, '标注') AND contains(line, '★')) AS marked FROM l GROUP BY 1),
o AS (SELECT doc_id, count(*) AS extracted, count_if(level = 'redline') AS redlines, count_if(level = 'important') AS important FROM req GROUP BY 1)
SELECT doc_id, marked, coalesce(extracted, 0) AS extracted, coalesce(redlines, 0) AS redlines, coalesce(important, 0) AS important, greatest(0, marked - coalesce(redlines, 0)) AS uncovered FROM k2 LEFT JOIN o USING (doc_id)""")
def clause_coverage(spark, sf_dir):
    lines = clause_lines(spark, sf_dir)
    return clauses.clause_coverage(clauses.requirements(lines), lines)


@query(f"""WITH {OWN.split(", m AS")[0]} SELECT doc_id, pos, length(line) BETWEEN 1 AND 29 AND NOT regexp_matches(line, '{clauses.INSISTS}') AND NOT regexp_matches(line, '[。；;！!？?：:，,]$') AS label,
length(line) >= 8 AND NOT contains(line, '标注') AND NOT regexp_matches(line, '{clauses.TOTALS}') AND (contains(line, '★') OR contains(line, '▲') OR regexp_matches(line, '{clauses.ASKS}')) AS requirement FROM c""")
def sentence_kinds(spark, sf_dir):
    rows = clause_lines(spark, sf_dir)
    return rows.select("doc_id", "pos", clauses.is_label(F.col("line")).alias("label"), clauses.is_requirement(F.col("line"), F.col("levels")).alias("requirement"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE [CASE WHEN o_orderstatus = 'F' THEN concat('需要支持', o_orderpriority) ELSE concat(o_orderpriority, '：需要支持', o_orderpriority) END] END AS rows FROM orders""")
def requirement_tables(spark, sf_dir):
    """Tables of one requirement: a number, a name, what is asked, an amount and the name again; every fifth is a scoring table."""
    asked = F.concat(F.lit("需要支持"), "o_orderpriority")
    row = F.array(F.lit("12"), F.when(F.col("o_orderstatus") == "F", asked).otherwise(F.col("o_orderpriority")), asked, F.lit("3万元"), asked)
    head = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("需求"), F.lit("分值"))).otherwise(F.array(F.lit("序号"), F.lit("技术要求")))
    return table(spark, sf_dir, "orders").select("o_orderkey", clauses.requirement_rows(F.array(head, row)).alias("rows"))


@query("""SELECT c_custkey, concat('项目名称：', c_name, ' 项目编号：X-', c_custkey, chr(10), '采购人 ', c_mktsegment, '。预算金额: ', c_nationkey, '万元，含税') AS said, c_name AS name, concat('X-', c_custkey) AS number, CASE WHEN c_nationkey < 0 THEN '' ELSE concat(c_nationkey, '万元') END AS budget FROM customer""")
def labelled_values(spark, sf_dir):
    said = F.concat(F.lit("项目名称："), "c_name", F.lit(" 项目编号：X-"), "c_custkey", F.lit("\n采购人 "), "c_mktsegment", F.lit("。预算金额: "), "c_nationkey", F.lit("万元，含税"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", said.alias("said"))
    following = "项目编号|项目名称|预算金额"
    return rows.select("c_custkey", "said", clauses.labelled(F.col("said"), "项目名称|招标项目名称", next_field=following).alias("name"), clauses.labelled(F.col("said"), "项目编号|招标编号").alias("number"), clauses.labelled(F.col("said"), "预算金额|最高限价").alias("budget"))


@query("""WITH r AS (SELECT conv_id AS doc_id, role AS field, turn AS seq, CASE turn % 3 WHEN 0 THEN '未提及' WHEN 1 THEN ' ' ELSE text END AS value FROM conversations)
SELECT doc_id, field, arg_min(value, seq) AS value FROM r WHERE trim(value) NOT IN ('', '未提及') GROUP BY ALL""")
def merged_values(spark, sf_dir):
    value = F.when(F.col("turn") % 3 == 0, "未提及").when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text"))
    return clauses.merged_values(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("field"), F.col("turn").alias("seq"), value.alias("value")))


@query("""WITH r AS (SELECT conv_id % 5 AS doc_id, role AS field, conv_id * 1000 + turn AS seq, unnest(string_split(text, ' ')[:6]) AS item, generate_subscripts(string_split(text, ' ')[:6], 1) AS place FROM conversations),
k AS (SELECT *, substr(item, 1, 80) AS key FROM r WHERE item != ''), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, field, key ORDER BY seq, place) = 1)
SELECT doc_id, field, list(item ORDER BY seq, place) AS items FROM f GROUP BY ALL""")
def merged_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("doc_id"), F.col("role").alias("field"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.slice(F.split("text", " "), 1, 6).alias("items"))
    return clauses.merged_lists(rows)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 2 THEN concat('Here it is: ', props, ' done') ELSE 'no object' END AS raw, CASE WHEN event_id % 4 < 3 THEN props END AS json FROM events""")
def loose_json(spark, sf_dir):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" done"))).otherwise("no object")
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", "raw", clauses.loose_json(F.col("raw")).alias("json"))


@query()
def text_segments(spark, sf_dir):
    """Whole texts cut at line ends; a fold that SQL cannot state."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(clauses.segments(F.col("text"), 500)).alias("segment", "text"))


# Occurrences on `events`: an hour of a user is a section; purchases stand for assets, signups for placeholders.
OCCURRENCES = """SELECT user_id AS section_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS start, CAST(floor(epoch(ts) / 3600) AS BIGINT) + CAST(value AS BIGINT) % 30 + 1 AS "end",
concat(event_type, ':', CASE WHEN event_type = 'signup' THEN event_id ELSE event_id % 3 END) AS item_key, CASE event_type WHEN 'signup' THEN 'placeholder' WHEN 'purchase' THEN 'asset' ELSE 'commitment' END AS kind,
CASE WHEN event_type = 'purchase' THEN concat('a', event_id % 3) END AS asset_key, CAST(event_id % 3 AS VARCHAR) AS basis FROM events"""
MET = f"""o AS ({OCCURRENCES}), j AS (SELECT h.item_key, count(DISTINCT a.asset_key) AS n, min((a.asset_key, a.item_key, a.basis, a.kind)) AS a FROM o h JOIN o a ON h.section_id = a.section_id AND h.start < a."end" AND a.start < h."end" WHERE h.kind = 'placeholder' AND a.asset_key IS NOT NULL GROUP BY 1),
t AS (SELECT section_id, start, "end", CASE WHEN n = 1 THEN a[2] ELSE item_key END AS item_key, CASE WHEN n = 1 THEN a[4] ELSE kind END AS kind, CASE WHEN n = 1 THEN a[1] ELSE asset_key END AS asset_key, CASE WHEN n = 1 THEN a[3] ELSE basis END AS basis FROM o LEFT JOIN j USING (item_key)),
w AS (SELECT *, coalesce(max("end") OVER (PARTITION BY item_key, section_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) <= start AS fresh FROM t),
i AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY item_key, section_id ORDER BY start, "end") AS k FROM w), runs AS (SELECT item_key, section_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY item_key, section_id, k)"""


def occurrences(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "placeholder").when(F.col("event_type") == "purchase", "asset").otherwise("commitment")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    number = F.when(F.col("event_type") == "signup", F.col("event_id")).otherwise(F.col("event_id") % 3)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("section_id"), hour.alias("start"), (hour + F.bround("value", 0).cast("long") % 30 + 1).alias("end"), F.concat("event_type", F.lit(":"), number).alias("item_key"), kind.alias("kind"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("a"), F.col("event_id") % 3)).alias("asset_key"), (F.col("event_id") % 3).cast("string").alias("basis"),
    )


@query(f"WITH {MET} SELECT section_id, start, \"end\", item_key, kind, asset_key, basis FROM t")
def inherited_items(spark, sf_dir):
    return verification.inherited(occurrences(spark, sf_dir))


@query(f"WITH {MET} SELECT * FROM runs")
def merged_occurrences(spark, sf_dir):
    return verification.merged(verification.inherited(occurrences(spark, sf_dir)))


@query(f"WITH {MET} SELECT count(DISTINCT item_key) AS items, count(*) AS occurrences FROM runs")
def verification_counts(spark, sf_dir):
    return verification.counts(merged_occurrences(spark, sf_dir))


@query("""SELECT c_custkey AS item_key, CAST(c_nationkey AS VARCHAR) AS basis, CASE WHEN s_suppkey IS NULL THEN 'open' WHEN s_nationkey = c_nationkey THEN 'confirmed' ELSE 'stale' END AS state FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def decision_states(spark, sf_dir):
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item_key"), F.col("s_nationkey").cast("string").alias("basis"))
    return verification.decided(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_key"), F.col("c_nationkey").cast("string").alias("basis")), made)


@query("""WITH v AS (SELECT event_type AS topic, 'day' AS dimension, CAST(user_id % 4 AS VARCHAR) AS scope, user_id AS section_id, event_id AS pos, CAST(CAST(event_id % 3 AS INT) AS VARCHAR) AS value FROM events),
f AS (SELECT topic, dimension, scope, value, min((section_id, pos)) AS first_at FROM v GROUP BY ALL), s AS (SELECT topic, dimension, scope, count(DISTINCT section_id) AS n FROM v GROUP BY ALL)
SELECT topic, dimension, scope, list(value ORDER BY first_at) AS clusters FROM f JOIN s USING (topic, dimension, scope) WHERE n > 1 GROUP BY ALL HAVING count(*) > 1""")
def value_conflicts(spark, sf_dir):
    number = (F.col("event_id") % 3).cast("int")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.lit("day").alias("dimension"), (F.col("user_id") % 4).cast("string").alias("scope"), F.col("user_id").alias("section_id"), F.col("event_id").alias("pos"), number.cast("string").alias("value"), number.cast("double").alias("number"), F.lit(False).alias("approx"))
    return verification.value_conflicts(rows)
