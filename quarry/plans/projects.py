"""Evidence, projects, proposals and retrieval upkeep over the driver tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import hashing, numbers, text
from ..operators import checks, evidence, lines, projects, retrieval, usage, versions
from ..sources.tables import calls, paragraphs, table
from ..streaming import windows, writes
from .registry import SQL, query
from .tenders import value_conflicts

# Assets on suppliers, items on parts, links on lineitem: a part's suppliers; some links lead nowhere.
STATUS = "CASE s_suppkey % 6 WHEN 0 THEN 'example' WHEN 1 THEN 'expired' WHEN 2 THEN 'to verify' ELSE 'complete' END"
SEVERITY = "['example', 'expired', 'wrong holder', 'broken link', 'no attachment', 'to verify']"
LINKS = "SELECT DISTINCT l_partkey AS item_id, concat('s:', CASE WHEN l_partkey % 9 = 0 THEN l_suppkey + 100000 ELSE l_suppkey END) AS key FROM lineitem"
REPORT = f"""l AS ({LINKS}), a AS (SELECT concat('s:', s_suppkey) AS key, {STATUS} AS status FROM supplier),
j AS (SELECT item_id, l.key, a.key IS NOT NULL AS known, coalesce(a.status, 'broken link') AS status FROM l LEFT JOIN a USING (key)),
g AS (SELECT item_id, coalesce({SEVERITY}[min(list_position({SEVERITY}, status))], 'complete') AS status, count_if(known) AS links, coalesce(list_sort(list(key) FILTER (NOT known)), []) AS missing FROM j GROUP BY 1),
r AS (SELECT p_partkey AS item_id, coalesce(status, 'not linked') AS status, coalesce(links, 0) AS links, coalesce(missing, []) AS missing FROM part LEFT JOIN g ON item_id = p_partkey WHERE p_size % 2 = 0 OR status IS NOT NULL)"""


def asset_rows(spark, sf_dir):
    n = F.col("s_suppkey") % 6
    status = F.when(n == 0, "example").when(n == 1, "expired").when(n == 2, "to verify").otherwise("complete")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("key"), status.alias("status"), F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_name"))


def link_rows(spark, sf_dir):
    key = F.concat(F.lit("s:"), F.when(F.col("l_partkey") % 9 == 0, F.col("l_suppkey") + 100000).otherwise(F.col("l_suppkey")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), key.alias("key")).distinct()


@query(f"WITH {REPORT} SELECT * FROM r")
def evidence_report(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_size") % 2 == 0).alias("needed"))
    return evidence.report(items, link_rows(spark, sf_dir), asset_rows(spark, sf_dir))


@query(f"WITH {REPORT} SELECT count(*) AS total, count_if(status = 'complete') AS complete FROM r")
def evidence_summary(spark, sf_dir):
    return evidence.summary(evidence_report(spark, sf_dir))


@query(f"""WITH l AS ({LINKS}), a AS (SELECT concat('s:', s_suppkey) AS key, CASE WHEN s_suppkey % 3 = 0 THEN [] ELSE [s_name, concat(s_name, '.pdf')] END AS files FROM supplier),
f AS (SELECT item_id, key, unnest(files) AS file FROM l JOIN a USING (key)), fa AS (SELECT item_id, list_sort(list({{'key': key, 'file': file}})) AS attachments FROM f GROUP BY 1),
m AS (SELECT item_id, list_sort(list(l.key)) AS missing FROM l LEFT JOIN a USING (key) WHERE a.key IS NULL GROUP BY 1),
s AS (SELECT o.p AS item_id, list_sort(list(DISTINCT {{'id': o.o_orderkey, 'written': o.o_orderstatus = 'F'}})) AS sections FROM (SELECT o_orderkey, o_orderstatus, o_custkey % 97 + 1 AS p FROM orders) o GROUP BY 1)
SELECT p_partkey AS item_id, coalesce(sections, []) AS sections, coalesce(attachments, []) AS attachments, coalesce(missing, []) AS missing FROM part LEFT JOIN s ON s.item_id = p_partkey LEFT JOIN fa ON fa.item_id = p_partkey LEFT JOIN m ON m.item_id = p_partkey""")
def scoring_index(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    mapped = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97 + 1).alias("item_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("written"))
    files = F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("s_name", F.concat("s_name", F.lit(".pdf"))))
    return evidence.index_rows(items, mapped, link_rows(spark, sf_dir), asset_rows(spark, sf_dir).select("key", files.alias("files")))


@query(f"SELECT concat('s:', s_suppkey) AS key, {STATUS} AS status FROM supplier WHERE {STATUS} != 'example'")
def usable_assets(spark, sf_dir):
    return evidence.usable(asset_rows(spark, sf_dir)).select("key", "status")


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'expired' WHEN o_orderkey % 5 = 0 THEN 'holder_mismatch' END AS reason FROM orders""")
def blocked_assets(spark, sf_dir):
    k = F.col("o_orderkey")
    problems = F.filter(F.array(F.when(k % 2 == 0, "unverified"), F.when(k % 3 == 0, "expired"), F.when(k % 5 == 0, "holder_mismatch")), lambda c: c.isNotNull())
    kept, gone = evidence.split_blocked(table(spark, sf_dir, "orders").select(k.alias("key"), problems.alias("problems")))
    return kept.select("key", F.lit(None).cast("string").alias("reason")).unionByName(gone.select("key", "reason"))


@query("""WITH s AS (SELECT l_orderkey AS owner, l_linenumber AS key, max(l_discount) AS score FROM lineitem GROUP BY ALL), h AS (SELECT *, max(CAST(score >= 0.08 AS INT)) OVER (PARTITION BY owner) AS hit FROM s)
SELECT owner, key, score, CAST(row_number() OVER (PARTITION BY owner ORDER BY CASE WHEN hit = 1 THEN -score ELSE 0 END, key) AS INT) AS rank FROM h WHERE hit = 0 OR score >= 0.08 QUALIFY rank <= 3""")
def relevant_assets(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("key")).agg(F.max("l_discount").alias("score"))
    return evidence.relevant(scored, "owner", 0.08, 3)


@query("""SELECT l_orderkey AS owner, l_returnflag AS kind, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS keys FROM lineitem WHERE l_linestatus != 'O' GROUP BY ALL""")
def linked_by_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("key"), F.when(F.col("l_linestatus") == "O", "example").otherwise("confirmed").alias("status"))
    return evidence.by_kind(rows)


@query("""SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN 'no reference' END, CASE WHEN event_id % 3 = 0 THEN 'no asset' END, CASE WHEN event_id % 4 > 0 THEN concat(event_id % 4, ' assets kept out') END], lambda x: x IS NOT NULL) AS gaps FROM events""")
def evidence_gaps(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", evidence.gaps(n % 2, n % 3, n % 4).alias("gaps"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '2026-01-31' END AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'stated' WHEN o_orderkey % 3 = 1 THEN 'today' ELSE 'today, not readable' END AS source FROM orders""")
def deadlines(spark, sf_dir):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    raw = F.when(k == 0, F.concat(F.year(d), F.lit("年"), F.month(d), F.lit("月"), F.dayofmonth(d), F.lit("日 9:00"))).when(k == 2, "未提及")
    return table(spark, sf_dir, "orders").select("o_orderkey", evidence.deadline(raw, date(2026, 1, 31)).alias("d")).select("o_orderkey", "d.*")


# Projects on customers, tasks and proposals on orders.
@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INT) AS place FROM customer WHERE c_mktsegment != 'BUILDING' ORDER BY place LIMIT 100")
def active_projects(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("status", F.when(F.col("c_mktsegment") == "BUILDING", "deleted").otherwise("active"))
    return projects.newest_first(rows, [F.desc("c_acctbal"), F.asc("c_custkey")], 100, active=True).select("c_custkey", "place")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS place FROM orders ORDER BY place LIMIT 50")
def recent_tasks(spark, sf_dir):
    return projects.newest_first(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 50).select("o_orderkey", "place")


@query("""SELECT o_custkey AS project_id, count(*) AS total, count_if(o_orderstatus = 'F') AS done, round_even(100 * count_if(o_orderstatus = 'F') / count(*), 1) AS rate FROM orders GROUP BY 1""")
def completion_rates(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("draft")
    return projects.completion(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), status.alias("status")), "project_id")


@query("""SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, count_if(turn % 3 = 0) AS with_vectors, (SELECT list_sort(list(DISTINCT t)) FROM (SELECT unnest([role, concat(role, turn % 2)]) AS t FROM conversations)) AS tags FROM (SELECT conv_id AS doc_id, turn FROM conversations)""")
def library_stats(spark, sf_dir):
    return projects.library_stats(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.array("role", F.concat("role", F.col("turn") % 2)).alias("tags"), (F.col("turn") % 3 == 0).alias("has_vector")))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' AND (contains(lower(p_name), 're') OR contains(lower(p_type), 're')) UNION ALL SELECT p_partkey FROM part WHERE p_brand != 'Brand#1' AND contains(lower(p_type), 'el')")
def asset_search(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", F.col("p_brand").alias("category"))
    return projects.search(rows, ["p_name", "p_type"], "RE", "Brand#1").unionByName(projects.search(rows.filter("category != 'Brand#1'"), ["p_type"], "El")).select("p_partkey")


@query("""WITH a AS (SELECT o_custkey AS project_id, o_orderpriority AS clause FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT c_custkey AS project_id, c_mktsegment AS clause FROM customer) SELECT * FROM a UNION ALL SELECT * FROM b WHERE project_id NOT IN (SELECT project_id FROM a)""")
def redline_items(spark, sf_dir):
    first = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("clause"))
    return projects.with_fallback(first, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("clause")), "project_id")


@query("""WITH c AS (SELECT l_orderkey AS project, l_linenumber AS item, max(l_quantity) AS share, max(l_returnflag) AS flag, max(l_linestatus) AS state FROM lineitem GROUP BY ALL),
a AS (SELECT project, item FROM c WHERE flag = 'R' QUALIFY row_number() OVER (PARTITION BY project ORDER BY share DESC, item) = 1),
b AS (SELECT project, item FROM c WHERE (project, item) NOT IN (SELECT (project, item) FROM a) QUALIFY row_number() OVER (PARTITION BY project ORDER BY share DESC, item) = 1),
d AS (SELECT project, item FROM c WHERE state = 'O' AND (project, item) NOT IN (SELECT (project, item) FROM a) AND (project, item) NOT IN (SELECT (project, item) FROM b) QUALIFY row_number() OVER (PARTITION BY project ORDER BY share, item) = 1)
SELECT *, 'team' AS category FROM a UNION ALL SELECT *, 'proposal' FROM b UNION ALL SELECT *, 'service' FROM d""")
def picked_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("project"), F.col("l_linenumber").alias("item")).agg(F.max("l_quantity").alias("share"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("state"))
    rules = [("team", F.col("flag") == "R", [F.desc("share"), F.asc("item")]), ("proposal", F.lit(True), [F.desc("share"), F.asc("item")]), ("service", F.col("state") == "O", [F.asc("share"), F.asc("item")])]
    return projects.picked(rows, rules, "project", "item")


NAMES = """f AS (SELECT c_nationkey AS grp, trim(value) AS value FROM (SELECT c_nationkey, c_mktsegment AS value FROM customer UNION ALL SELECT c_nationkey, CAST(c_custkey AS VARCHAR) FROM customer) WHERE length(trim(value)) >= 2 AND NOT regexp_matches(trim(value), '^[0-9]{1,5}$')
UNION SELECT s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN '待填写' ELSE s_name END FROM supplier),
n AS (SELECT grp, list(value ORDER BY length(value) DESC, value) AS names FROM (SELECT DISTINCT * FROM f WHERE value NOT IN ('未提及', '待填写', '')) GROUP BY 1)"""


def given_names(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.explode(F.array("c_mktsegment", F.col("c_custkey").cast("string"))).alias("value"))
    given = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.when(F.col("s_suppkey") % 3 == 0, "待填写").otherwise(F.col("s_name")).alias("value"))
    return customer, given, "grp"


@query(f"WITH {NAMES} SELECT * FROM n")
def identifiers(spark, sf_dir):
    return projects.identifiers(*given_names(spark, sf_dir))


@query(f"""WITH {NAMES}, t AS (SELECT o_custkey % 25 AS grp, o_orderkey, lower(replace(CASE WHEN o_orderkey % 2 = 0 THEN concat('x BUIL DING ', o_orderpriority) ELSE concat('supp lier of sUpplier#', lpad(CAST(o_orderkey % 100 AS VARCHAR), 9, '0')) END, ' ', '')) AS text FROM orders), e AS (SELECT grp, unnest(names) AS identifier FROM n)
SELECT grp, o_orderkey, identifier FROM t JOIN e USING (grp) WHERE contains(text, lower(replace(identifier, ' ', '')))""")
def identifier_hits(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x BUIL DING "), "o_orderpriority")).otherwise(F.concat(F.lit("supp lier of sUpplier#"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 9, "0")))
    texts = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).cast("int").alias("grp"), "o_orderkey", said.alias("text"))
    return projects.identifier_hits(projects.identifier_rows(*given_names(spark, sf_dir)), texts, "grp", "o_orderkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def unhidden_examples(spark, sf_dir):
    real = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    return projects.unhidden(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), real, "c_nationkey")


@query("""WITH r AS (SELECT l_orderkey AS section, CASE WHEN l_linenumber % 2 = 0 THEN 'single' ELSE 'refine' END AS method, l_returnflag != 'N' AS ok, CAST(l_quantity AS BIGINT) AS blocking, l_linenumber AS calls FROM lineitem),
e AS (SELECT section, bool_or(method = 'single' AND ok) AND bool_or(method = 'refine' AND ok) AS p, sum(blocking) FILTER (method = 'single') AS sb, sum(calls) FILTER (method = 'single') AS sc, sum(blocking) FILTER (method = 'refine') AS rb, sum(calls) FILTER (method = 'refine') AS rc FROM r GROUP BY 1)
SELECT count(*) AS sections, count_if(p) AS paired, CAST(coalesce(sum(sb) FILTER (p), 0) AS BIGINT) AS single_blocking, CAST(coalesce(sum(sc) FILTER (p), 0) AS BIGINT) AS single_calls, CAST(coalesce(sum(rb) FILTER (p), 0) AS BIGINT) AS refine_blocking, CAST(coalesce(sum(rc) FILTER (p), 0) AS BIGINT) AS refine_calls,
CASE WHEN count_if(p) = 0 THEN NULL ELSE sum(rb) FILTER (p) <= sum(sb) FILTER (p) * 0.5 END AS fewer_blocking FROM e""")
def method_comparison(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section"), F.when(F.col("l_linenumber") % 2 == 0, "single").otherwise("refine").alias("method"), (F.col("l_returnflag") != "N").alias("ok"), F.bround("l_quantity", 0).cast("long").alias("blocking"), F.col("l_linenumber").cast("long").alias("calls"))
    rows = projects.compared(runs, ("single", "refine"), ["blocking", "calls"])
    return rows.withColumn("fewer_blocking", projects.gate(F.col("single_blocking"), F.col("refine_blocking"), 0.5, F.col("paired")))


@query("""WITH d AS (SELECT o_custkey AS project_id, CASE o_orderstatus WHEN 'F' THEN '完全满足' WHEN 'P' THEN '负偏离' ELSE CASE WHEN o_orderkey % 2 = 0 THEN '正偏离' END END AS answer FROM orders)
SELECT project_id, count(*) AS clauses, count_if(answer = '负偏离') AS negative, count_if(answer IS NULL) AS pending, CASE WHEN count_if(answer = '负偏离') > 0 THEN 'negative' WHEN count_if(answer IS NULL) > 0 THEN 'pending' ELSE 'met' END AS conclusion FROM d GROUP BY 1""")
def deviation_summary(spark, sf_dir):
    s = F.col("o_orderstatus")
    answer = F.when(s == "F", "完全满足").when(s == "P", "负偏离").when(F.col("o_orderkey") % 2 == 0, "正偏离")
    return projects.deviation_summary(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), answer.alias("answer")), "project_id")


@query("""SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 3 != 0 THEN concat('answer ', c_custkey) ELSE c_mktsegment END AS detail, c_custkey % 2 = 0 AND c_nationkey % 3 != 0 AS applied FROM customer""")
def write_back(spark, sf_dir):
    """Half of the rows have answers; a third was edited after the snapshot."""
    current = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("detail"))
    snapshot = current.withColumn("detail", F.when(F.col("c_nationkey") % 3 == 0, "before").otherwise(F.col("detail")))
    answers = current.filter("c_custkey % 2 = 0").select("c_custkey", "c_nationkey", F.concat(F.lit("answer "), "c_custkey").alias("detail"))
    return projects.write_back(current, snapshot, answers, ["c_custkey", "c_nationkey"], ["detail"], ["detail"])


@query("""SELECT c_custkey AS id, 'name' AS clause_id, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END FROM customer WHERE c_custkey % 4 != 0
UNION ALL SELECT c_custkey, concat('words:', i), w FROM (SELECT c_custkey, unnest(string_split(c_name, '#')) AS w, generate_subscripts(string_split(c_name, '#'), 1) - 1 AS i FROM customer) WHERE trim(w) != '' UNION ALL SELECT o_custkey, concat('clause:', o_orderkey), o_orderpriority FROM orders""")
def clause_list(spark, sf_dir):
    analysis = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"), F.split("c_name", "#").alias("words"))
    deviations = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("clause_id"), F.col("o_orderpriority").alias("text"))
    return projects.clause_list(analysis, "id", ["name", "segment"], ["words"], deviations)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'given' ELSE s_name END AS s_name, s_nationkey FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'given', 7 FROM supplier WHERE s_suppkey % 3 = 0""")
def replaced_assets(spark, sf_dir):
    stored = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    third = stored.filter("s_suppkey % 3 = 0").withColumn("s_name", F.lit("given")).withColumn("s_nationkey", F.lit(7))
    return projects.replaced(stored, third.unionByName(third.withColumn("s_suppkey", F.col("s_suppkey") + 1000000)), ["s_suppkey"], ["s_nationkey"])


PROPOSALS = "CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'O' THEN 'draft' ELSE 'checked' END"


def proposal_rows(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "applied").when(F.col("o_orderstatus") == "O", "draft").otherwise("checked")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("section_id"), status.alias("status"))


@query(f"SELECT o_orderkey AS id, o_custkey AS section_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus != 'F' THEN 'rejected' ELSE {PROPOSALS} END AS status FROM orders")
def closed_proposals(spark, sf_dir):
    rows = proposal_rows(spark, sf_dir)
    return projects.closed(rows, rows.filter("id % 3 = 0"), "rejected").select("id", "section_id", "status")


@query(f"SELECT o_orderkey AS id, o_custkey AS section_id, {PROPOSALS} AS status, CAST(row_number() OVER (ORDER BY o_orderkey DESC) AS INT) AS place FROM orders WHERE o_orderstatus != 'F' ORDER BY place LIMIT 200")
def open_proposals(spark, sf_dir):
    return projects.newest_first(proposal_rows(spark, sf_dir).filter(F.col("status").isin("draft", "checked")), [F.desc("id")], 200)


@query("""SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL THEN 'lost' WHEN c_nationkey != o_orderkey % 3 + 3 THEN 'behind' WHEN o_orderkey % 4 = 0 THEN 'outdated' ELSE 'current' END AS state, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END AS changed FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 != 0) ON c_custkey = o_custkey""")
def proposal_states(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("section_id"), (F.col("o_orderkey") % 3 + 3).alias("base_revision"))
    current = table(spark, sf_dir, "customer").filter("c_custkey % 5 != 0").select(F.col("c_custkey").alias("section_id"), F.col("c_nationkey").alias("revision"))
    changes = rows.filter("id % 4 = 0").select("id", F.explode(F.array(F.lit("facts"), F.lit("outline"))).alias("input"))
    return projects.proposal_state(rows, current, changes)


@query("""WITH c AS (SELECT user_id AS section_id, ts, event_id AS run_id, ts + INTERVAL 3 HOUR AS released FROM events) SELECT section_id, run_id, coalesce(max(released) OVER (PARTITION BY section_id ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= ts, true) AS granted FROM c""")
def first_claims(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("section_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("run_id"))
    return projects.first_claims(rows.withColumn("released", F.col("ts") + F.expr("INTERVAL 3 HOURS"))).select("section_id", "run_id", "granted")


@query("""SELECT p_partkey, p_size, concat(CASE WHEN p_size >= 20 THEN substr('一二三四五六七八九十', p_size // 10, 1) ELSE '' END, CASE WHEN p_size >= 10 THEN '十' ELSE '' END, CASE WHEN p_size % 10 > 0 THEN substr('一二三四五六七八九十', p_size % 10, 1) ELSE '' END) AS numeral,
CASE WHEN p_size % 7 = 0 THEN '分值未识别' WHEN p_size % 2 = 0 THEN concat(p_size, '.5分') ELSE concat(p_size, '分') END AS points FROM part""")
def numerals(spark, sf_dir):
    size = F.col("p_size")
    points = F.when(size % 7 == 0, F.lit(None).cast("double")).when(size % 2 == 0, size + 0.5).otherwise(size.cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", projects.cn_number(size).alias("numeral"), projects.points_text(points).alias("points"))


@query("""SELECT p_partkey, list_sort(list_distinct(list_filter([substr(p_brand, 1, 20), p_type, p_brand], lambda x: length(x) BETWEEN 2 AND 20))) AS found FROM part""")
def node_keywords(spark, sf_dir):
    said = F.array(F.concat(F.lit("第三章 "), "p_brand"), F.concat(F.lit("评分项："), "p_type", F.lit("（12.5分）")), F.concat(F.lit("须覆盖："), "p_brand", F.lit("；")), F.lit("1.2 "))
    rows = table(spark, sf_dir, "part").select("p_partkey", projects.keywords(said).alias("found"))
    return rows.select("p_partkey", F.array_sort("found").alias("found"))


@query("""WITH c AS (SELECT conv_id AS grp, turn AS clause_id, substr(regexp_replace(text, '\\s+', '', 'g'), 1, 40) AS key FROM conversations WHERE turn % 2 = 0), v AS (SELECT conv_id AS grp, turn AS pos, regexp_replace(concat('> ', text), '\\s+', '', 'g') AS echo FROM conversations)
SELECT grp, clause_id, min(pos) AS pos FROM c JOIN v USING (grp) WHERE key != '' AND (contains(echo, key) OR contains(key, substr(echo, 1, 40))) GROUP BY ALL""")
def echoed_clauses(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    clauses = rows.filter("turn % 2 = 0").select(F.col("conv_id").alias("grp"), F.col("turn").alias("clause_id"), F.col("text").alias("clause"))
    return projects.echoed(clauses, rows.select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), F.concat(F.lit("> "), "text").alias("echo")), "grp")


@query("SELECT p_partkey AS item_id, CAST(p_size AS DOUBLE) AS points FROM part WHERE p_partkey % 3 != 0 ORDER BY p_size DESC, p_partkey LIMIT 5")
def worst_covered(spark, sf_dir):
    status = F.when(F.col("p_partkey") % 3 == 0, "covered").otherwise("points missing")
    return projects.worst_covered(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("double").alias("points"), status.alias("status"))).select("item_id", "points")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events),
r AS (SELECT user_id, ts, event_id, k FROM e WHERE k = 1 UNION ALL SELECT n.user_id, n.ts, n.event_id, n.k FROM r JOIN LATERAL (SELECT * FROM e WHERE e.user_id = r.user_id AND e.k > r.k AND epoch_ms(e.ts) - epoch_ms(r.ts) >= 36000000 ORDER BY e.k LIMIT 1) n ON true)
SELECT user_id AS task_id, event_id FROM r""")
def throttled_progress(spark, sf_dir):
    """Of each task's events the first, and each that comes ten hours or more after the last one told."""
    instants = windows.as_instant(table(spark, sf_dir, "events"), "ts")
    return writes.throttled(instants.select(F.col("user_id").alias("task_id"), "ts", "event_id"), seconds=36_000)


# Upkeep of usage, lines and vectors.
@query("""SELECT event_id AS call_id FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'""")
def usage_last_days(spark, sf_dir):
    return usage.filtered(calls(spark, sf_dir), since=usage.since_days(7, date(2024, 1, 30))).select("call_id")


@query(f"""WITH g AS (SELECT conv_id % 3 AS grp, conv_id * 1000 + turn AS doc_id, regexp_replace(unnest(string_split(text, chr(10))), '[{text.BLANKS}]+', '', 'g') AS line FROM conversations), c AS (SELECT grp, line, count(DISTINCT doc_id) AS docs FROM g WHERE line != '' AND length(line) <= 40 GROUP BY ALL), t AS (SELECT grp, count(DISTINCT doc_id) AS total FROM g GROUP BY 1),
f AS (SELECT grp, line FROM c JOIN t USING (grp) WHERE docs >= greatest(2, ceil(0.02 * total))) SELECT grp, doc_id, line FROM g WHERE (grp, line) NOT IN (SELECT (grp, line) FROM f)""")
def without_furniture(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 3).alias("grp"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    rows = docs.select("grp", "doc_id", F.explode(text.lines(F.col("text"))).alias("line"))
    return lines.without_furniture(rows, lines.furniture(docs, "grp", 0.02), "grp").withColumn("line", text.without_blanks(F.col("line")))


VECTORS = "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'new' END AS version, vec_id % 7 = 0 AS bad FROM embeddings"


def vector_rows(spark, sf_dir):
    bad = F.transform("embedding", lambda x: F.when(F.lit(True), float("nan")).otherwise(x).cast("float"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 5 == 0, "old").otherwise("new").alias("version"), F.when(F.col("vec_id") % 7 == 0, bad).otherwise(F.col("embedding")).alias("vector"))


@query(f"SELECT version, 64 AS dim, count(*) AS n, count_if(version = 'new' AND NOT bad) AS ready FROM ({VECTORS}) GROUP BY 1")
def vector_readiness(spark, sf_dir):
    return retrieval.staleness(vector_rows(spark, sf_dir), "new", 64)


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM ({VECTORS}) WHERE version = 'new' AND NOT bad)")
def stale_vectors(spark, sf_dir):
    return retrieval.stale_vectors(table(spark, sf_dir, "documents"), vector_rows(spark, sf_dir), "new").select("doc_id")


@query("""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, role AS title, concat('part ', conv_id) AS path, text, CASE WHEN turn % 2 = 0 THEN string_split(text, ' ')[:8] END AS req FROM conversations)
SELECT query_id, CAST(0 AS INT) AS variant, text FROM q UNION ALL SELECT query_id, 1, substr(concat(trim(concat(path, ' ', title)), ' ', text), 1, 512) FROM q WHERE title != '' AND NOT contains(text, title)
UNION ALL SELECT query_id, 2, substr(concat(title, ' ', array_to_string(req[:6], ' ')), 1, 512) FROM q WHERE req IS NOT NULL AND array_to_string(req[:6], ' ') != ''""")
def expanded_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("role").alias("title"), F.concat(F.lit("part "), "conv_id").alias("path"), "text", F.when(F.col("turn") % 2 == 0, F.slice(F.split("text", " "), 1, 8)).alias("requirements"))
    return retrieval.expanded(rows)


@query("""WITH r AS (SELECT l_suppkey AS query_id, l_orderkey AS doc_id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM r)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM k WHERE place <= 15 AND doc_id % 3 = 0 QUALIFY rank <= 5""")
def filtered_after_cut(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("doc_id")).agg(F.max("l_extendedprice").alias("score"))
    allowed = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"))
    return retrieval.filtered_after_cut(retrieval.ranked(scored, "query_id", "doc_id", 100), allowed, 5)


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 < 2 OR contains(text, role) THEN text ELSE concat(role, chr(10), text) END AS composed, concat('《', role, '》', CASE WHEN turn % 2 = 0 THEN concat(' ', 'part ', turn) ELSE '' END, chr(10), text) AS context FROM conversations""")
def chunk_texts(spark, sf_dir):
    summary = F.when(F.col("turn") % 3 == 1, F.col("text")).when(F.col("turn") % 3 == 2, F.col("role"))
    crumb = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("part "), "turn"))
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.compose(summary, F.col("text")).alias("composed"), text.context_text(F.col("role"), crumb, F.col("text")).alias("context"))


@query("""SELECT event_id, concat('p:', event_type, ':', substr(sha256(props), 1, 16)) AS version, concat(event_type, ':', user_id) AS key, event_type AS kind, CAST(user_id AS VARCHAR) AS name FROM events""")
def embedding_keys(spark, sf_dir):
    key = hashing.key(F.col("event_type"), F.col("user_id"))
    rows = table(spark, sf_dir, "events").select("event_id", hashing.embedding_version(F.lit("p"), F.col("event_type"), F.col("props")).alias("version"), key.alias("key"), hashing.split_key(key).alias("s"))
    return rows.select("event_id", "version", "key", "s.kind", "s.name")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN abs(l_quantity - l_suppkey % 50) <= CASE WHEN l_returnflag = 'N' THEN 8640 ELSE 6 END ELSE l_quantity = l_suppkey % 50 END AS same FROM lineitem""")
def same_values(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    side = lambda n, approx: F.struct(F.when(F.col("l_returnflag") == "N", "minute").otherwise("day").alias("dimension"), n.cast("double").alias("number"), n.cast("long").cast("string").alias("value"), approx.alias("approx"))
    same = numbers.same_value(side(F.col("l_quantity"), F.col("l_linenumber") % 2 == 0), side(F.col("l_suppkey") % 50, F.lit(False)))
    return rows.select("l_orderkey", "l_linenumber", same.alias("same"))


@query("""SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')), '^ | $', '', 'g') AS text FROM pages WHERE html IS NOT NULL""")
def plain_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", text.plain_html(F.col("html")).alias("text"))


@query("""WITH l AS (SELECT user_id AS project_id, arg_max(event_type, (ts, event_id)) AS kind, max(ts) AS last_at, arg_max(value, (ts, event_id)) AS risks FROM events GROUP BY 1), p AS (SELECT c_custkey AS project_id, TIMESTAMP '2024-01-15' + INTERVAL 1 DAY * (c_nationkey % 20) AS updated FROM customer)
SELECT project_id, CASE WHEN kind IS NULL THEN 'unknown' WHEN kind IN ('error', 'view') THEN 'unknown' WHEN risks >= 60 THEN 'attention' WHEN updated > last_at THEN 'unknown' ELSE 'ok' END AS state FROM p LEFT JOIN l USING (project_id)""")
def redline_states(spark, sf_dir):
    """The last check of each project: failed ones and those that the project has outlived say nothing."""
    events = table(spark, sf_dir, "events")
    runs = events.select(F.col("user_id").alias("project_id"), F.col("ts").alias("checked_at"), F.col("event_id").alias("run_id"), F.when(F.col("event_type").isin("error", "view"), "failed").otherwise("completed").alias("status"), F.when(F.col("value") >= 60, 1).otherwise(0).alias("risks"))
    day = F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00' + make_dt_interval(c_nationkey % 20)")
    return checks.redline_state(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), day.alias("updated_at")), runs)


# The eight checks before a document goes out, on conversations as sections and the tables above.
PREFLIGHT = f"""n AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS content, turn % 3 = 0 AS reviewed, turn % 5 AS revision, turn % 2 AS seen FROM conversations),
c AS (SELECT 'unwritten' AS code, CAST(id AS VARCHAR) AS detail FROM n WHERE trim(content) = '' UNION ALL SELECT 'placeholders', CAST(id AS VARCHAR) FROM n WHERE regexp_matches(concat(content, CASE WHEN id % 7 = 0 THEN '【待填写】' ELSE '' END), '{text.PLACEHOLDER}')
UNION ALL SELECT 'unreviewed', CAST(id AS VARCHAR) FROM n WHERE trim(content) != '' AND (NOT reviewed OR revision != seen) UNION ALL SELECT 'material', CAST(item_id AS VARCHAR) FROM r WHERE status != 'complete'
UNION ALL SELECT 'deviations', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'assets', concat('s:', s_suppkey) FROM supplier WHERE {STATUS} = 'to verify'
UNION ALL SELECT 'consistency', concat(topic, '|', scope) FROM ({SQL['value_conflicts']}) UNION ALL SELECT 'redlines', CAST(project_id AS VARCHAR) FROM ({SQL['redline_states']}) WHERE state = 'attention')"""


@query(f"""WITH {REPORT}, {PREFLIGHT} SELECT k.code, count(detail) AS attention, coalesce(list_sort(list(DISTINCT detail) FILTER (detail IS NOT NULL))[:50], []) AS details, count(detail) = 0 AS ok
FROM (VALUES ('unwritten'), ('placeholders'), ('unreviewed'), ('material'), ('deviations'), ('assets'), ('consistency'), ('redlines')) k(code) LEFT JOIN c USING (code) GROUP BY k.code""")
def preflight_checks(spark, sf_dir):
    turn = F.col("turn")
    nodes = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + turn).alias("id"), F.when(turn % 4 == 3, "").otherwise(F.col("text")).alias("content"), F.when(turn % 3 == 0, "reviewed").otherwise("draft").alias("status"), (turn % 5).alias("revision"), (turn % 2).alias("reviewed_revision"))
    marked = nodes.withColumn("content", F.concat("content", F.when(F.col("id") % 7 == 0, "【待填写】").otherwise("")))
    detail = lambda df, c: df.select(F.col(c).cast("string").alias("detail"))
    return checks.preflight({
        "unwritten": detail(checks.unwritten(nodes), "id"), "placeholders": detail(checks.with_placeholders(marked), "id"), "unreviewed": detail(checks.unreviewed(nodes), "id"),
        "material": detail(evidence_report(spark, sf_dir).filter("status != 'complete'"), "item_id"), "deviations": detail(table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'"), "o_orderkey"),
        "assets": detail(asset_rows(spark, sf_dir).filter("status = 'to verify'"), "key"), "consistency": detail(value_conflicts(spark, sf_dir).select(F.concat_ws("|", "topic", "scope").alias("place")), "place"),
        "redlines": detail(redline_states(spark, sf_dir).filter("state = 'attention'"), "project_id"),
    })
