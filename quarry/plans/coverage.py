"""Matching, coverage, budgets and checks over the driver tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.text import BLANKS
from ..operators import checks, coverage, matching, trees
from ..sources.tables import table
from .registry import query

CORE = "regexp_replace(regexp_replace(coalesce({0}, ''), '" + matching.SEPARATORS + "', '', 'g'), '" + matching.FILLER + "', '', 'g')"
BARE = f"regexp_replace(coalesce({{0}}, ''), '[{BLANKS}]+', '', 'g')"
PAIRS = "list_distinct(list_transform(list_zip(string_split({0}, ''), string_split({0}, '')[2:], true), lambda x: concat(x[1], x[2])))"


def overlap_sql(bare_point, core_point, bare_text, core_text):
    """Overlap of a point and a text, of which all four forms are columns."""
    grams = PAIRS.format(core_point)
    gaps = f"concat('\\Q', array_to_string(string_split({core_point}, ''), '\\E(?s:.){{0,2}}\\Q'), '\\E')"
    return f"""CASE WHEN {bare_point} = '' OR contains({bare_text}, {bare_point}) OR (length({core_point}) >= 2 AND contains({core_text}, {core_point})) THEN 1.0::DOUBLE
WHEN length({core_point}) >= 3 AND regexp_matches({core_text}, {gaps}) THEN 1.0 WHEN length({core_point}) < 2 OR len({grams}) < 2 THEN 0.0
ELSE len(list_filter({grams}, lambda g: contains({core_text}, g))) / len({grams})::DOUBLE END"""


@query(f"""WITH j AS (SELECT conv_id, turn, p_name AS point, {BARE.replace('{0}', 'p_name')} AS bp, {CORE.replace('{0}', 'p_name')} AS cp, {BARE.replace('{0}', 'text')} AS bt, {CORE.replace('{0}', 'text')} AS ct FROM conversations JOIN part ON p_partkey = conv_id)
SELECT conv_id, turn, point, round({overlap_sql('bp', 'cp', 'bt', 'ct')}, 6) AS overlap FROM j""")
def point_overlap(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("conv_id"), F.col("p_name").alias("point"))
    rows = table(spark, sf_dir, "conversations").join(points, "conv_id")
    return rows.select("conv_id", "turn", "point", F.round(matching.point_overlap(F.col("point"), F.col("text")), 6).alias("overlap"))


# Texts in letters are put into ideographs, which the rules of matching are made for.
LATIN, IDEOGRAPHS = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏律吕"
SQL_IDEO = "translate(lower({0}), '" + LATIN + "', '" + IDEOGRAPHS + "')"
MATCHES = f"""WITH ph AS (SELECT min(p_partkey) AS part_id, concat({SQL_IDEO.format('p_name')}, CASE WHEN min(p_partkey) % 5 = 0 THEN ' 27001' ELSE '' END) AS text FROM part GROUP BY p_name),
p AS (SELECT part_id, regexp_replace(upper({BARE.replace('{0}', 'text')}), '{matching.GENERIC}', '', 'g') AS core, len(regexp_extract_all(text, '[0-9]{{5}}')) AS codes FROM ph),
d AS (SELECT doc_id, upper(regexp_replace({SQL_IDEO.format("coalesce(text, '')")}, '[{BLANKS}]+', '', 'g')) AS t FROM documents),
k AS (SELECT part_id, codes, unnest({PAIRS.format('core')}) AS gram, len({PAIRS.format('core')}) AS n FROM p),
dp AS (SELECT doc_id, unnest({PAIRS.format('t')}) AS gram FROM d),
r AS (SELECT part_id, doc_id, count(*) / n::DOUBLE AS ratio FROM k JOIN dp USING (gram) JOIN d USING (doc_id)
  WHERE codes = 0 OR regexp_matches(t, '(^|[^0-9])27001([^0-9]|$)') GROUP BY part_id, doc_id, n),
m AS (SELECT part_id, doc_id, ratio FROM r WHERE ratio >= 0.5)
"""


def ideographs(column):
    return F.translate(F.lower(column), LATIN, IDEOGRAPHS)


def matches(spark, sf_dir):
    key = F.min("p_partkey")
    phrases = table(spark, sf_dir, "part").groupBy("p_name").agg(key.alias("part_id")).select("part_id", F.concat(ideographs(F.col("p_name")), F.when(F.col("part_id") % 5 == 0, " 27001").otherwise("")).alias("text"))
    texts = table(spark, sf_dir, "documents").select("doc_id", ideographs(F.coalesce("text", F.lit(""))).alias("text"))
    return matching.ratios(phrases, texts, "part_id", "doc_id", 0.5, per_phrase=8)


@query(MATCHES + "SELECT part_id, doc_id, round(ratio, 6) AS ratio, row_number() OVER (PARTITION BY part_id ORDER BY ratio DESC, doc_id) AS rank FROM m QUALIFY rank <= 8")
def best_match(spark, sf_dir):
    return matching.best_matches(matches(spark, sf_dir), "part_id", "doc_id").withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH j AS (SELECT conv_id, turn, p_name AS point, {BARE.replace('{0}', 'p_name')} AS bp, {CORE.replace('{0}', 'p_name')} AS cp, {BARE.replace('{0}', 'text')} AS bt, {CORE.replace('{0}', 'text')} AS ct FROM conversations JOIN part ON p_partkey = conv_id),
o AS (SELECT conv_id, turn, round({overlap_sql('bp', 'cp', 'bt', 'ct')}, 6) AS overlap FROM j)
SELECT conv_id AS owner, 0 AS point_id, turn AS leaf_id, overlap FROM o WHERE overlap >= 0.2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn) = 1""")
def assigned_points(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("owner"), F.lit(0).alias("point_id"), F.col("p_name").alias("point"))
    leaves = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("leaf_id"), F.col("turn").alias("pos"), "text")
    return matching.closest_leaf(points, leaves, 0.2)


KEYWORDS = "SELECT keyword, bool_or(p) AS p FROM (SELECT unnest(regexp_extract_all(" + SQL_IDEO.format("text") + ", '[\\x{4e00}-\\x{9fff}]{6,}')) AS keyword, item_id % 2 = 0 AS p FROM benchmark) GROUP BY keyword"
PAGES = "SELECT page_id, " + SQL_IDEO.format("coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '')") + " AS title, " + SQL_IDEO.format("coalesce(html, '')") + " AS body FROM pages"
HITS = f"""WITH k AS ({KEYWORDS}), s AS ({PAGES}), j AS (SELECT page_id, keyword, (3 * CAST(contains(title, keyword) AS INT) + CAST(contains(body, keyword) AS INT)) * CASE WHEN p THEN 2 ELSE 1 END AS points
  FROM s, k WHERE contains(title, keyword) OR contains(body, keyword)), h AS (SELECT page_id, CAST(sum(points) AS BIGINT) AS score, list_sort(list(keyword)) AS hits FROM j GROUP BY page_id) """


def keywords_and_pages(spark, sf_dir):
    """Long words of `benchmark` as keywords, primary in even items, and pages with title and body; all put into ideographs."""
    words = F.regexp_extract_all(ideographs(F.col("text")), F.lit(r"[\x{4e00}-\x{9fff}]{6,}"), F.lit(0))
    keywords = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("keyword"), (F.col("item_id") % 2 == 0).alias("primary"))
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<title>(.*?)</title>", 1)
    return keywords, table(spark, sf_dir, "pages").select("page_id", ideographs(title).alias("title"), ideographs(F.coalesce("html", F.lit(""))).alias("body"))


@query(HITS + "SELECT page_id, score, hits FROM h")
def keyword_sections(spark, sf_dir):
    return matching.keyword_hits(*keywords_and_pages(spark, sf_dir), "page_id")


@query(HITS + "SELECT page_id, score, hits FROM h ORDER BY score DESC, page_id LIMIT 8")
def related_sections(spark, sf_dir):
    return matching.related_sections(*keywords_and_pages(spark, sf_dir), "page_id")


def items(spark, sf_dir):
    """Requirements on `benchmark`: points, kind and what is wanted (its long words)."""
    number = F.col("item_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in coverage.KIND_FACTOR]), (number % 4 + 1).cast("int"))
    points = F.when(number % 11 != 0, (number % 7).cast("double"))
    wanted = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{11,}"), F.lit(0)))
    return table(spark, sf_dir, "benchmark").select("item_id", points.alias("points"), kind.alias("kind"), wanted.alias("wanted"))


def outline(spark, sf_dir):
    """Sources as chapters with documents as sections."""
    docs = table(spark, sf_dir, "documents")
    chapter = F.concat(F.lit("s:"), F.coalesce("source", F.lit("")))
    sections = docs.select(F.concat(F.lit("d:"), "doc_id").alias("id"), chapter.alias("parent_id"), F.coalesce("lang", F.lit("")).alias("title"), F.col("text").alias("content"), F.col("n_chars").alias("budget"))
    chapters = docs.select(chapter.alias("id")).distinct().select("id", F.lit(None).cast("string").alias("parent_id"), F.col("id").alias("title"), F.lit("").alias("content"), F.lit(None).cast("long").alias("budget"))
    return chapters.unionByName(sections)


def carriers(spark, sf_dir):
    """Items carried by documents of their number's remainder class among the items, and by the chapter of the document with their number."""
    docs = table(spark, sf_dir, "documents")
    n = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    each = docs.filter("doc_id >= 0").join(F.broadcast(n)).select((F.col("doc_id") % F.col("n")).alias("item_id"), F.concat(F.lit("d:"), "doc_id").alias("id"), F.col("doc_id"), F.col("n"), "source")  # one row
    first = each.filter("doc_id < n").select("item_id", F.concat(F.lit("s:"), F.coalesce("source", F.lit(""))).alias("id"))
    return each.filter("item_id % 10 != 3").select("item_id", "id").unionByName(first.filter("item_id % 10 < 2"))


COVERAGE = f"""WITH items AS (SELECT item_id, CASE WHEN item_id % 11 != 0 THEN CAST(item_id % 7 AS DOUBLE) END AS points, ['proposal', 'demo', 'compliance', 'evidence'][item_id % 4 + 1] AS kind,
  list_distinct(regexp_extract_all(text, '[A-Za-z]{{11,}}')) AS wanted FROM benchmark),
n AS (SELECT count(*) AS n FROM benchmark),
m AS (SELECT doc_id % n AS item_id, doc_id FROM documents, n WHERE doc_id % n % 10 != 3),
ch AS (SELECT doc_id % n AS item_id, coalesce(source, '') AS source FROM documents, n WHERE doc_id < n AND doc_id % 10 < 2),
inside AS (SELECT item_id, doc_id FROM m UNION SELECT ch.item_id, d.doc_id FROM ch JOIN documents d ON coalesce(d.source, '') = ch.source
  WHERE NOT EXISTS (SELECT 1 FROM m JOIN documents e USING (doc_id) WHERE m.item_id = ch.item_id AND coalesce(e.source, '') = ch.source)),
t AS (SELECT doc_id, n_chars AS budget, regexp_replace(coalesce(text, ''), '[{BLANKS}]+', '', 'g') != '' AS written, concat(lang, chr(10), text) AS text,
  length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)```.*?(?:```|\\z)', '', 'g'), '(?m)^[ \\t]*\\|?[ \\t]*:?-{{3,}}:?[ \\t]*(?:\\|[ \\t]*:?-{{3,}}:?[ \\t]*)*\\|?[ \\t]*$', '', 'g'), '(?m)^[ \\t]*[-+*][ \\t]+', '', 'g'), '[|*#>`]', '', 'g'), '[{BLANKS}]+', '', 'g')) AS words,
  {BARE.replace('{0}', "concat(lang, chr(10), text)")} AS bt, {CORE.replace('{0}', "concat(lang, chr(10), text)")} AS ct FROM documents),
s AS (SELECT inside.item_id, t.*, kind, points FROM inside JOIN t USING (doc_id) JOIN items USING (item_id)),
sums AS (SELECT item_id, sum(coalesce(budget, 0)) AS budget, sum(coalesce(budget, 0)) FILTER (written) AS written_budget, sum(words) FILTER (written) AS words, bool_or(written) AS written FROM s GROUP BY item_id),
w AS (SELECT item_id, unnest(wanted) AS point FROM items),
wp AS (SELECT item_id, point, {BARE.replace('{0}', 'point')} AS bp, {CORE.replace('{0}', 'point')} AS cp FROM w),
hit AS (SELECT DISTINCT item_id, point FROM wp JOIN s USING (item_id) WHERE written AND {overlap_sql('bp', 'cp', 'bt', 'ct')} >= 0.7),
miss AS (SELECT item_id, list_sort(list(point)) AS missing FROM (SELECT item_id, point FROM w EXCEPT SELECT item_id, point FROM hit) GROUP BY item_id),
r AS (SELECT items.*, budget, coalesce(written_budget, 0) AS written_budget, coalesce(words, 0) AS words, written, coalesce(missing, []) AS missing FROM items LEFT JOIN sums USING (item_id) LEFT JOIN miss USING (item_id)),
c AS (SELECT *, kind = 'proposal' AND CASE WHEN written_budget > 0 THEN written_budget ELSE budget END > 0 AND words < 0.3 * CASE WHEN written_budget > 0 THEN written_budget ELSE budget END AS short, coalesce(NOT written, true) AS unwritten FROM r),
covered AS (SELECT item_id, points, CASE WHEN written IS NULL THEN 'not carried' WHEN unwritten THEN 'not written' WHEN len(missing) > 0 THEN 'points missing' WHEN short THEN 'too short' ELSE 'covered' END AS status,
  CASE WHEN unwritten THEN 0.0 ELSE round_even(CASE WHEN len(wanted) > 0 THEN 1 - len(missing) / len(wanted)::DOUBLE ELSE 1.0 END * CASE WHEN short THEN 0.5 ELSE 1.0 END, 3) END AS coverage,
  len(wanted) AS n_points, CASE WHEN unwritten THEN [] ELSE missing END AS missing, CAST(words AS BIGINT) AS words, CAST(coalesce(budget, 0) AS BIGINT) AS budget FROM c)
"""


def covered(spark, sf_dir):
    nodes = outline(spark, sf_dir)
    return coverage.coverage(items(spark, sf_dir), nodes, carriers(spark, sf_dir), trees.closure(nodes))


@query(COVERAGE + "SELECT * FROM covered")
def coverage_items(spark, sf_dir):
    return covered(spark, sf_dir)


@query(COVERAGE + "SELECT round(sum(w * coverage) / sum(w), 6) AS rate FROM (SELECT coverage, CASE WHEN coalesce(points, 0) = 0 THEN 1.0 ELSE points END AS w FROM covered)")
def coverage_rate(spark, sf_dir):
    return coverage.coverage_rate(covered(spark, sf_dir))


@query("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id % n FROM documents, (SELECT count(*) AS n FROM benchmark) WHERE doc_id % n % 10 != 3 OR (doc_id < n AND doc_id % 10 < 2))")
def uncovered_items(spark, sf_dir):
    return coverage.without_chapter(items(spark, sf_dir), carriers(spark, sf_dir)).select("item_id")


@query("SELECT c_nationkey AS package, round(sum(c_acctbal), 6) AS points, 0 AS unknown, abs(round(sum(c_acctbal), 6) - 100) < 0.01 AS complete FROM customer GROUP BY 1")
def points_by_package(spark, sf_dir):
    return coverage.points_by_package(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("package"), F.col("c_acctbal").alias("points")))


@query("""WITH ch AS (SELECT c_nationkey AS grp, c_custkey AS chapter_id, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE greatest(c_acctbal, 0) END AS weight FROM customer),
lv AS (SELECT c_nationkey AS grp, o_custkey AS chapter_id, o_orderkey AS leaf_id, coalesce(CASE WHEN o_orderkey % 3 != 0 THEN CAST(o_orderkey % 5 + 1 AS DOUBLE) END, 1.0) AS w FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT grp, chapter_id, sum(w) AS leaves, count(*) AS n FROM lv GROUP BY ALL), m AS (SELECT grp, min(weight) FILTER (weight > 0) AS least FROM ch GROUP BY grp),
o AS (SELECT grp, chapter_id, leaves, CASE WHEN least IS NULL THEN coalesce(n, 1)::DOUBLE WHEN weight > 0 THEN weight ELSE least * 0.5 END AS w FROM ch LEFT JOIN s USING (grp, chapter_id) JOIN m USING (grp)),
b AS (SELECT *, CAST(round_even(800000.0::DOUBLE * w / (sum(w) OVER (PARTITION BY grp)) / 100, 0) AS BIGINT) * 100 AS budget FROM o)
SELECT grp, chapter_id, NULL::BIGINT AS leaf_id, budget FROM b UNION ALL SELECT grp, chapter_id, leaf_id, greatest(200, CAST(round_even(budget * lv.w / leaves / 50, 0) AS BIGINT) * 50) FROM lv JOIN b USING (grp, chapter_id)""")
def budget_allocation(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("chapter_id"), "c_acctbal")
    chapters = customer.withColumn("weight", F.when(F.col("grp") % 5 == 0, 0.0).otherwise(F.greatest("c_acctbal", F.lit(0.0)))).drop("c_acctbal")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chapter_id"), F.col("o_orderkey").alias("leaf_id"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 5 + 1).cast("double")).alias("weight"))
    return coverage.word_budgets(chapters, orders.join(customer.select("grp", "chapter_id"), "chapter_id"), 1_000_000, ["grp"])


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS item_id FROM lineitem), i AS (SELECT p_partkey AS item_id, CAST(p_size AS DOUBLE) AS points, CASE WHEN p_size % 2 = 0 THEN 'demo' ELSE 'evidence' END AS kind FROM part),
c AS (SELECT item_id, count(*) AS n FROM m GROUP BY 1)
SELECT id, round(sum(points * CASE kind WHEN 'demo' THEN 0.3 ELSE 0.2 END / n), 6) AS weight FROM m JOIN i USING (item_id) JOIN c USING (item_id) GROUP BY id""")
def shared_points(spark, sf_dir):
    mapped = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item_id")).distinct()
    kinds = F.when(F.col("p_size") % 2 == 0, "demo").otherwise("evidence")
    return coverage.shared_points(mapped, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("double").alias("points"), kinds.alias("kind")))


@query("""WITH n AS (SELECT conv_id, turn, role != 'system' AS written FROM conversations)
SELECT conv_id, turn AS id, (SELECT coalesce(list(b.turn ORDER BY b.turn DESC), []) FROM (SELECT turn FROM n b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.written ORDER BY turn DESC LIMIT 3) b) AS siblings FROM n a""")
def recent_siblings(spark, sf_dir):
    nodes = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.col("conv_id").alias("parent_id"), F.col("turn").alias("ordinal"), (F.col("role") != "system").alias("written"))
    rows = coverage.recent_siblings(nodes)
    return rows.select("id.conv_id", F.col("id.turn").alias("id"), F.transform("siblings", lambda s: s["turn"]).alias("siblings"))


TODAY, DEADLINE = date(1998, 6, 1), date(1999, 1, 31)


@query("""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'qualifications' ELSE 'cases' END AS kind, CASE o_orderstatus WHEN 'P' THEN 'unverified' WHEN 'F' THEN 'example' ELSE 'confirmed' END AS status,
  o_orderkey % 3 AS attachments, last_day(CAST(o_orderdate AS DATE)) AS expiry, o_orderkey % 7 = 0 AS forever, o_orderkey % 13 = 0 AS odd, o_custkey % 5 = 0 AS foreign_holder FROM orders),
p AS (SELECT id, list_filter([CASE status WHEN 'example' THEN 'example' WHEN 'unverified' THEN 'unverified' END, CASE WHEN attachments = 0 THEN 'no_attachment' END,
  CASE WHEN kind = 'qualifications' AND NOT forever THEN CASE WHEN odd THEN 'expiry_unknown' WHEN expiry < DATE '1998-06-01' THEN 'expired' WHEN expiry < DATE '1999-01-31' THEN 'expiring' END END,
  CASE WHEN foreign_holder THEN 'holder_mismatch' END], lambda c: c IS NOT NULL) AS problems FROM a)
SELECT id, problems, CASE WHEN list_contains(problems, 'example') THEN 'example' WHEN list_has_any(problems, ['expired', 'expiring']) THEN 'expired' WHEN list_contains(problems, 'holder_mismatch') THEN 'wrong holder'
  WHEN list_contains(problems, 'no_attachment') THEN 'no attachment' WHEN list_has_any(problems, ['unverified', 'expiry_unknown']) THEN 'to verify' ELSE 'complete' END AS status,
  list_has_any(problems, ['expired', 'expiring', 'holder_mismatch']) AS blocked FROM p""")
def material_check(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    expiry = F.when(k % 7 == 0, "长期").when(k % 13 == 0, "see annex").otherwise(F.concat_ws("/", F.year(d), F.month(d)))
    status = F.when(F.col("o_orderstatus") == "P", "unverified").when(F.col("o_orderstatus") == "F", "example").otherwise("confirmed")
    holder = F.when(F.col("o_custkey") % 5 == 0, "Other Ltd.").otherwise("(Own) Co.")
    problems = checks.material_problems(F.when(k % 2 == 0, "qualifications").otherwise("cases"), status, k % 3, expiry, holder, F.lit("Own Co"), F.lit(TODAY), F.lit(DEADLINE))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), problems.alias("problems"))
    return rows.select("id", "problems", checks.worst_of(F.col("problems")).alias("status"), checks.blocking(F.col("problems")).alias("blocked"))


@query("""WITH s AS (SELECT coalesce(source, '') AS source, length(trim(coalesce(text, ''))) > 20 AS written, n_chars > 300 AS complete, lang IS NOT NULL AS consistent, contains(coalesce(text, ''), chr(10)) AS structured,
  NOT contains(lower(coalesce(text, '')), 'the') AS plain, regexp_matches(coalesce(text, ''), '[0-9]') AS concrete, contains(coalesce(text, ''), '|') AS illustrated, doc_id IN (SELECT doc_id FROM labels) AS aligned, NOT contains(coalesce(text, ''), '!') AS formal FROM documents),
r AS (SELECT source, count(*) AS sections, """ + ", ".join(f"CAST(round_even(100 * avg(CASE WHEN written THEN CAST({n} AS INT) END), 0) AS INT) AS {n}" for n in ["complete", "consistent", "structured", "plain", "concrete", "illustrated", "aligned", "formal"]) + """ FROM s GROUP BY source),
t AS (SELECT *, CAST(round_even((complete + consistent + structured + plain + concrete + illustrated + aligned + formal) / 8.0, 0) AS INT) AS total FROM r)
SELECT *, CASE WHEN total >= 90 THEN 'excellent' WHEN total >= 75 THEN 'good' WHEN total >= 60 THEN 'to improve' ELSE 'at risk' END AS rating FROM t""")
def quality_dims(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "documents").join(known, "doc_id", "left").select(
        F.coalesce("source", F.lit("")).alias("source"), (F.length(F.trim(text)) > 20).alias("written"), (F.col("n_chars") > 300).alias("complete"), F.col("lang").isNotNull().alias("consistent"), F.contains(text, F.lit("\n")).alias("structured"),
        (~F.contains(F.lower(text), F.lit("the"))).alias("plain"), text.rlike("[0-9]").alias("concrete"), F.contains(text, F.lit("|")).alias("illustrated"), F.coalesce("known", F.lit(False)).alias("aligned"), (~F.contains(text, F.lit("!"))).alias("formal"),
    )
    return checks.quality_dimensions(rows, "source")


CLAUSES = "SELECT item_id, item_id % 3 AS grp, concat('★本项目 ', CASE WHEN item_id % 2 = 0 THEN " + SQL_IDEO.format("text") + " ELSE text END) AS clause FROM benchmark WHERE text IS NOT NULL"


@query(f"""WITH c AS ({CLAUSES}), t AS (SELECT item_id, grp, unnest(list_filter(regexp_extract_all(regexp_replace(clause, '[★▲]', '', 'g'), '{checks.SCAN_TERM}'), lambda w: w NOT IN {checks.SCAN_STOP})) AS term FROM c),
p AS (SELECT page_id % 3 AS grp, concat(html, ' ', {SQL_IDEO.format("html")}) AS text FROM pages WHERE length(trim(html)) > 20),
f AS (SELECT grp, term FROM (SELECT DISTINCT grp, term FROM t) d WHERE EXISTS (SELECT 1 FROM p WHERE p.grp = d.grp AND contains(p.text, d.term))),
h AS (SELECT grp, item_id, count(*) AS hits, max(length(term)) AS longest FROM t JOIN f USING (grp, term) GROUP BY ALL)
SELECT grp, item_id, coalesce(hits, 0) AS hits, coalesce(hits >= 2 OR longest >= 5, false) AS covered FROM c LEFT JOIN h USING (grp, item_id)""")
def quick_scan(spark, sf_dir):
    said = F.when(F.col("item_id") % 2 == 0, ideographs(F.col("text"))).otherwise(F.col("text"))
    clauses = table(spark, sf_dir, "benchmark").filter("text IS NOT NULL").select("item_id", (F.col("item_id") % 3).alias("grp"), F.concat(F.lit("★本项目 "), said).alias("clause"))
    pages = table(spark, sf_dir, "pages").filter(F.length(F.trim("html")) > 20)
    texts = pages.select(F.col("page_id").alias("text_id"), (F.col("page_id") % 3).alias("grp"), F.concat("html", F.lit(" "), ideographs(F.col("html"))).alias("text"))
    return checks.keyword_scan(clauses, texts, "item_id", "grp")


@query("""WITH q AS (SELECT event_id AS claim_id, CASE WHEN event_type = 'view' THEN 'warranty' ELSE 'response' END AS topic, CAST(user_id % 9 AS VARCHAR) AS scope, CASE WHEN event_id % 3 = 0 THEN 'day' ELSE 'minute' END AS dimension, floor(value) AS number,
  event_id % 4 = 0 AS approx, CASE event_id % 5 WHEN 0 THEN 'le' WHEN 1 THEN 'ge' ELSE 'eq' END AS comparator FROM events),
f AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'warranty' ELSE 'response' END AS topic, CAST(s_suppkey % 8 AS VARCHAR) AS scope, CASE WHEN s_suppkey % 3 = 0 THEN 'day' ELSE 'minute' END AS dimension, CAST(s_suppkey % 40 AS DOUBLE) AS number, false AS approx, CASE WHEN s_suppkey % 7 = 0 THEN 'le' ELSE 'eq' END AS comparator FROM supplier),
j AS (SELECT q.*, f.dimension IS NOT NULL AS cand, f.dimension = q.dimension AND CASE WHEN q.approx OR f.approx THEN abs(q.number - f.number) <= CASE q.dimension WHEN 'minute' THEN 8640 ELSE 6 END ELSE q.number = f.number END AS same,
  q.comparator IN ('le', 'ge') AND f.comparator IN ('le', 'ge') AND q.comparator != f.comparator AS opposite,
  CASE WHEN f.dimension = q.dimension THEN CASE WHEN q.topic = 'warranty' THEN q.number >= f.number ELSE q.number <= f.number END END AS better FROM q LEFT JOIN f ON q.topic = f.topic AND q.scope = f.scope)
SELECT claim_id, topic, scope, dimension, number, approx, comparator, CASE WHEN NOT bool_or(cand) THEN 'scope_unknown' WHEN bool_or(opposite) THEN 'conflict' WHEN bool_or(same) THEN 'backed' WHEN bool_or(better) THEN 'stronger'
  WHEN bool_or(cand AND better IS NULL) THEN 'incomparable' ELSE 'conflict' END AS relation FROM j GROUP BY ALL""")
def commitment_relations(spark, sf_dir):
    e, s = table(spark, sf_dir, "events"), table(spark, sf_dir, "supplier")
    n, k = F.col("event_id"), F.col("s_suppkey")
    claims = e.select(
        n.alias("claim_id"), F.when(F.col("event_type") == "view", "warranty").otherwise("response").alias("topic"), (F.col("user_id") % 9).cast("string").alias("scope"), F.when(n % 3 == 0, "day").otherwise("minute").alias("dimension"),
        F.floor("value").cast("double").alias("number"), F.floor("value").cast("string").alias("value"), (n % 4 == 0).alias("approx"), F.when(n % 5 == 0, "le").when(n % 5 == 1, "ge").otherwise("eq").alias("comparator"),
    )
    facts = s.select(
        F.when(k % 2 == 0, "warranty").otherwise("response").alias("topic"), (k % 8).cast("string").alias("scope"), F.when(k % 3 == 0, "day").otherwise("minute").alias("dimension"),
        (k % 40).cast("double").alias("number"), (k % 40).cast("string").alias("value"), F.lit(False).alias("approx"), F.when(k % 7 == 0, "le").otherwise("eq").alias("comparator"),
    )
    return checks.commitment_relations(claims, facts).drop("value")


@query("""WITH c AS (SELECT 'negative_balance' AS code, c_name AS detail FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'small_part', p_name FROM part WHERE p_size < 3 UNION ALL SELECT 'lost_region', n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region))
SELECT k.code, count(detail) AS attention, coalesce(list_sort(list(DISTINCT detail) FILTER (detail IS NOT NULL))[:50], []) AS details, count(detail) = 0 AS ok FROM (VALUES ('negative_balance'), ('small_part'), ('lost_region')) k(code) LEFT JOIN c USING (code) GROUP BY k.code""")
def preflight(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lost = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left_anti")
    return checks.preflight({
        "negative_balance": table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_name").alias("detail")),
        "small_part": table(spark, sf_dir, "part").filter("p_size < 3").select(F.col("p_name").alias("detail")),
        "lost_region": lost.select(F.col("n_name").alias("detail")),
    })


@query("""WITH r AS (SELECT conv_id AS section_id, turn AS round, length(text) % 3 AS blocking, length(text) % 5 AS quality, length(text) AS chars, 100 AS budget FROM conversations),
d AS (SELECT *, abs(chars / budget - 1) AS distance FROM r),
l AS (SELECT *, lag(blocking) OVER w AS b0, lag(quality) OVER w AS q0, lag(distance) OVER w AS d0, lag(round) OVER w AS r0 FROM d WINDOW w AS (PARTITION BY section_id ORDER BY round)),
p AS (SELECT *, CASE WHEN r0 IS NULL THEN true ELSE blocking <= b0 AND (blocking < b0 OR (b0 = 0 AND blocking = 0 AND quality < q0) OR (blocking <= b0 AND quality <= q0 AND distance < d0)) END AS progress FROM l),
i AS (SELECT *, sum(CAST(progress AS INT)) OVER (PARTITION BY section_id ORDER BY round) AS island FROM p),
s AS (SELECT *, sum(CAST(NOT progress AS INT)) OVER (PARTITION BY section_id, island ORDER BY round) AS streak FROM i),
f AS (SELECT section_id, max(streak) AS longest, count(*) - 1 AS rounds, arg_max(blocking, round) AS b, arg_max(quality, round) AS q, arg_max(distance, round) AS dist, arg_max(chars, round) AS c, arg_max(budget, round) AS bu, arg_max(streak, round) AS tr FROM s GROUP BY 1),
k AS (SELECT *, b = 0 AND q <= 2 AND dist <= 0.3 AS met FROM f), a AS (SELECT *, CASE WHEN met OR (longest >= 2 AND b = 0) THEN 'accept' WHEN rounds >= 2 THEN 'stop' ELSE 'revise' END AS kind FROM k)
SELECT section_id, kind, CASE WHEN kind = 'revise' THEN CASE WHEN b = 0 AND c / bu - 1 > 0.3 THEN 'compress' WHEN longest >= 2 THEN 'minimal' WHEN tr = 1 THEN 'alternate' ELSE 'normal' END END AS mode,
CASE WHEN met THEN 'goal_met' WHEN kind = 'accept' THEN 'no_improvement' WHEN kind = 'stop' THEN CASE WHEN tr > 0 THEN 'no_improvement' ELSE 'rounds_exhausted' END END AS reason, CAST(tr AS BIGINT) AS "trailing", CAST(longest AS BIGINT) AS longest FROM a""")
def refine_decide(spark, sf_dir):
    size = F.length("text")
    reports = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("section_id"), F.col("turn").alias("round"), (size % 3).alias("blocking"), (size % 5).alias("quality"), size.alias("chars"), F.lit(100).alias("budget"))
    return checks.revision_policy(reports)
