"""Retention, versions, joins, sets and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links, ranks, trees, versions
from ..sources.tables import sections, table
from .registry import query


@query("SELECT conv_id AS section_id, max(turn) AS version, arg_max(role, turn) AS source, arg_max(text, turn) AS content FROM conversations GROUP BY conv_id")
def latest_version(spark, sf_dir):
    return versions.latest_version(sections(spark, sf_dir))


@query("SELECT conv_id AS section_id, turn AS version FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def keep_last_n(spark, sf_dir):
    return versions.keep_last(sections(spark, sf_dir), ["section_id"], [F.desc("version")], 3).select("section_id", "version")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY")
def retention(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    newest = orders.agg(F.max("o_orderdate").alias("newest"))
    return orders.join(F.broadcast(newest)).filter(F.col("o_orderdate") >= F.col("newest") - F.expr("INTERVAL 180 DAYS")).drop("newest")  # one row


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def items_with_documents(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return links.with_documents(items, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")


@query("SELECT user_id, event_id FROM events WHERE user_id IS NULL OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id)")
def orphans(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("user_id", "event_id")
    return links.without_orphans(items, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), "user_id")


@query("""SELECT 'found' AS kind, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'missing', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def links_split(spark, sf_dir):
    found, missing = links.split_links(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    return found.agg(F.lit("found").alias("kind"), F.count("*").alias("n")).unionByName(missing.agg(F.lit("missing").alias("kind"), F.count("*").alias("n")))


@query("""SELECT n_nationkey, pos, n_name FROM (SELECT c_nationkey, unnest(ids) AS n_nationkey, generate_subscripts(ids, 1) - 1 AS pos
FROM (SELECT r_regionkey AS c_nationkey, [r_regionkey + 20, r_regionkey, 99, r_regionkey + 5] AS ids FROM region)) JOIN nation USING (n_nationkey)""")
def listed_order(spark, sf_dir):
    lists = table(spark, sf_dir, "region").select("r_regionkey", F.array(F.col("r_regionkey") + 20, "r_regionkey", F.lit(99), F.col("r_regionkey") + 5).alias("ids"))
    return links.in_listed_order(lists, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "ids", "n_nationkey").select("n_nationkey", "pos", "n_name")


@query("""SELECT c_custkey, coalesce(n.name, c_name) AS c_name, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS name FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) n ON o_custkey = c_custkey""")
def overlay(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    live = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_name"))
    return versions.overlay(stored, live, ["c_custkey"])


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey != 3 UNION ALL SELECT s_suppkey, upper(s_name) FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT -1 - n_nationkey, n_name FROM nation""")
def upsert(spark, sf_dir):
    stored = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    changed = stored.filter("s_nationkey = 3").withColumn("s_name", F.upper("s_name")).drop("s_nationkey")
    new = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("s_suppkey"), F.col("n_name").alias("s_name"))
    return versions.upsert(stored.drop("s_nationkey"), changed.unionByName(new), ["s_suppkey"])


@query("""SELECT (SELECT count(*) FROM customer WHERE c_nationkey != 4) AS documents, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)) AS chunks,
(SELECT count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)) AS items""")
def cascade_delete(spark, sf_dir):
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_nationkey")
    chunks, items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")), table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"))
    kept = versions.cascade_delete(documents, chunks, items, documents.filter("c_nationkey = 4").select("doc_id"))
    one, two, three = (t.agg(F.count("*").alias(n)) for t, n in zip(kept, ("documents", "chunks", "items"), strict=True))
    return F.broadcast(one).join(F.broadcast(two)).join(F.broadcast(three))  # one row each


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id) THEN 'interrupted' WHEN event_type = 'view' THEN 'pending' WHEN event_type = 'click' THEN 'running' ELSE event_type END AS status FROM events""")
def recovered_tasks(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").otherwise(F.col("event_type"))
    tasks = table(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("status"))
    return versions.interrupted(tasks, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id")), ["user_id"]).select("event_id", "status")


SHA = "sha256(concat(length({0}), ':', {0}))"


@query("""WITH a AS (SELECT conv_id, CAST(turn AS VARCHAR) AS input, role, text FROM conversations WHERE role != 'system'), b AS (SELECT conv_id, CAST(turn AS VARCHAR) AS input, role, CASE WHEN turn = 1 THEN 'new' ELSE text END AS text FROM conversations WHERE role != 'user')
SELECT conv_id, input, coalesce(b.role, a.role) AS label, CASE WHEN a.input IS NULL THEN 'added' WHEN b.input IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (conv_id, input) WHERE a.input IS NULL OR b.input IS NULL OR a.text IS DISTINCT FROM b.text""")
def manifest_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    old = versions.manifest(rows.filter("role != 'system'"), ["conv_id"], "turn", "role", "text")
    new = versions.manifest(rows.filter("role != 'user'").withColumn("text", F.when(F.col("turn") == 1, "new").otherwise(F.col("text"))), ["conv_id"], "turn", "role", "text")
    return versions.manifest_diff(old, new, ["conv_id"])


@query("SELECT conv_id, turn, turn IS NOT DISTINCT FROM (SELECT max(turn) FROM conversations c WHERE c.conv_id = d.conv_id AND role != 'user') AS accepted FROM conversations d")
def write_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    current = rows.filter("role != 'user'").groupBy("conv_id").agg(F.max("turn").alias("revision"))
    return versions.conflicts(rows.select("conv_id", "turn", F.col("turn").alias("base_revision")), current, ["conv_id"]).select("conv_id", "turn", "accepted")


@query("""WITH p AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'draft' WHEN 'click' THEN 'checked' WHEN 'purchase' THEN 'applied' ELSE 'rejected' END AS status FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, status IN ('draft', 'checked') ORDER BY event_id DESC) AS rn FROM p)
SELECT event_id, CASE WHEN status IN ('draft', 'checked') AND rn > 1 THEN 'superseded' ELSE status END AS status FROM r""")
def superseded(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "draft").when(F.col("event_type") == "click", "checked").when(F.col("event_type") == "purchase", "applied").otherwise("rejected")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", status.alias("status"))
    return versions.supersede(rows, ["user_id"], [F.desc("event_id")]).select("event_id", "status")


@query("SELECT user_id, count(*) AS proposals FROM events GROUP BY user_id")
def proposal_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("proposals"))


@query("""SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'kept' ELSE 'new' END AS status, 'node' AS kind FROM customer WHERE c_nationkey != 2
UNION ALL SELECT DISTINCT o_custkey, '', '', 'removed' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey != 2)""")
def tree_merge(spark, sf_dir):
    client = table(spark, sf_dir, "customer").filter("c_nationkey != 2").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("new").alias("status"))
    server = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("kept").alias("status")).distinct()
    merged, removed = versions.merge_trees(client, server, ["status"])
    return merged.withColumn("kind", F.lit("node")).unionByName(removed.select("id", F.lit("").alias("title"), F.lit("").alias("status"), F.lit("removed").alias("kind")))


@query("""WITH RECURSIVE p AS (SELECT conv_id * 100000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100000 + turn - 1 END AS parent_id, role = 'system' AS origin, conv_id AS section_id FROM conversations),
s AS (SELECT max(id) AS id FROM p GROUP BY section_id),
c(start_id, id, parent_id, origin, section_id, depth) AS (SELECT p.id, p.id, parent_id, origin, section_id, 0 FROM p JOIN s USING (id)
  UNION ALL SELECT c.start_id, p.id, p.parent_id, p.origin, p.section_id, c.depth + 1 FROM c JOIN p ON p.id = c.parent_id AND p.origin = c.origin AND p.section_id = c.section_id WHERE c.depth < 19)
SELECT start_id, id, depth FROM c""")
def lineage(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 100000 + F.col("turn")
    proposals = rows.select(number.alias("id"), F.when(F.col("turn") > 0, number - 1).alias("parent_id"), (F.col("role") == "system").alias("origin"), F.col("conv_id").alias("section_id"))
    return versions.lineage(proposals, proposals.groupBy("section_id").agg(F.max("id").alias("id")))


NODES = """WITH RECURSIVE nodes AS (SELECT concat('r', r_regionkey) AS id, NULL AS parent_id, r_name AS title, CAST(0 AS DOUBLE) AS v FROM region
UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name, CAST(0 AS DOUBLE) FROM nation UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), c_name, c_acctbal FROM customer),
reach(id, ancestor, distance) AS (SELECT id, id, CAST(0 AS BIGINT) FROM nodes UNION ALL SELECT reach.id, nodes.parent_id, distance + 1 FROM reach JOIN nodes ON nodes.id = reach.ancestor WHERE nodes.parent_id IS NOT NULL)
"""


def nodes(spark, sf_dir):
    """Regions, nations and customers as one tree."""
    at = lambda p, c: F.concat(F.lit(p), F.col(c))
    none = F.lit(0.0)
    regions = table(spark, sf_dir, "region").select(at("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"), none.alias("v"))
    nations = table(spark, sf_dir, "nation").select(at("n", "n_nationkey").alias("id"), at("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"), none.alias("v"))
    customers = table(spark, sf_dir, "customer").select(at("c", "c_custkey").alias("id"), at("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("v"))
    return regions.unionByName(nations).unionByName(customers)


@query(NODES + "SELECT id, ancestor, distance FROM reach")
def tree_closure(spark, sf_dir):
    return trees.closure(nodes(spark, sf_dir))


@query(NODES + "SELECT r.id, string_agg(n.title, ' > ' ORDER BY r.distance DESC) AS path FROM reach r JOIN nodes n ON n.id = r.ancestor GROUP BY r.id")
def breadcrumbs(spark, sf_dir):
    tree = nodes(spark, sf_dir)
    return trees.breadcrumbs(tree, trees.closure(tree))


@query(NODES + "SELECT r.ancestor AS id, round(sum(n.v), 2) AS v FROM reach r JOIN nodes n ON n.id = r.id GROUP BY r.ancestor")
def tree_totals(spark, sf_dir):
    tree = nodes(spark, sf_dir)
    return trees.rolled_up(tree, trees.closure(tree), "v").select("id", F.round("v", 2).alias("v"))


MAPPED = """, mapped AS (SELECT c_mktsegment AS item_id, concat('c', c_custkey) AS id FROM customer UNION ALL SELECT DISTINCT c_mktsegment, concat('n', c_nationkey) FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT n_name, concat('n', n_nationkey) FROM nation UNION ALL SELECT min(n_name), concat('r', n_regionkey) FROM nation GROUP BY n_regionkey)
"""


def mapped(spark, sf_dir):
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    own = customers.select(F.col("c_mktsegment").alias("item_id"), F.concat(F.lit("c"), "c_custkey").alias("id"))
    rich = customers.filter("c_acctbal > 5000").select(F.col("c_mktsegment").alias("item_id"), F.concat(F.lit("n"), "c_nationkey").alias("id")).distinct()
    named = nations.select(F.col("n_name").alias("item_id"), F.concat(F.lit("n"), "n_nationkey").alias("id"))
    regional = nations.groupBy(F.concat(F.lit("r"), "n_regionkey").alias("id")).agg(F.min("n_name").alias("item_id"))
    return own.unionByName(rich).unionByName(named).unionByName(regional)


@query(NODES.rstrip() + MAPPED + "SELECT item_id, id FROM mapped m WHERE NOT EXISTS (SELECT 1 FROM reach r JOIN mapped d ON d.id = r.id WHERE r.ancestor = m.id AND r.distance > 0 AND d.item_id = m.item_id)")
def most_specific(spark, sf_dir):
    return trees.most_specific(mapped(spark, sf_dir), trees.closure(nodes(spark, sf_dir)))


@query(NODES.rstrip() + MAPPED + """SELECT item_id, id FROM mapped m WHERE NOT EXISTS (SELECT 1 FROM mapped o WHERE o.item_id = m.item_id AND o.id != m.id
AND o.id NOT IN (SELECT r.id FROM reach r WHERE r.ancestor = m.id) AND o.id NOT IN (SELECT r.ancestor FROM reach r WHERE r.id = m.id))""")
def unshared_items(spark, sf_dir):
    return trees.unshared(mapped(spark, sf_dir), trees.closure(nodes(spark, sf_dir)))


@query(NODES + "SELECT id, title FROM nodes WHERE id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)")
def tree_leaves(spark, sf_dir):
    return trees.leaves(nodes(spark, sf_dir)).select("id", "title")


@query("SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY ALL")
def ordered_distinct(spark, sf_dir):
    return ranks.ordered_distinct(table(spark, sf_dir, "part"), ["p_brand"], "p_type", "p_partkey")


@query("""WITH a AS (SELECT substr(replace(p_name, ' ', ''), 1, 60) AS k, min(p_name) AS p_name FROM part GROUP BY 1), b AS (SELECT substr(replace(n, ' ', ''), 1, 60) AS k, min(n) AS p_name FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN concat(p_type, ' ', p_brand) ELSE concat(' ', p_name) END AS n FROM part) GROUP BY 1)
SELECT p_name FROM a UNION ALL SELECT p_name FROM b WHERE k NOT IN (SELECT k FROM a)""")
def key_union(spark, sf_dir):
    """Names of parts, and for every second part its type and brand, for the others the name with a blank before it."""
    parts = table(spark, sf_dir, "part")
    more = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(" "), "p_brand")).otherwise(F.concat(F.lit(" "), "p_name"))
    return links.normalised_union(parts.select("p_name"), parts.select(more.alias("p_name")), "p_name")


@query("""SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 END) WHEN 1 THEN 'P' WHEN 2 THEN 'O' ELSE 'complete' END AS o_orderstatus FROM orders GROUP BY o_custkey""")
def worst_status(spark, sf_dir):
    return links.worst(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", ["P", "O"], "complete")


@query("""WITH s AS (SELECT s_suppkey AS id, s_name AS text, s_acctbal AS points FROM supplier),
o AS (SELECT id, text, concat(text, chr(10), 'x') AS two FROM s)
SELECT s.id, s.points, CASE WHEN id % 3 = 0 THEN concat(o.two, '!') WHEN id % 3 = 1 THEN s.text ELSE 'new' END AS text, id % 3 != 2 AS active, CASE WHEN id % 3 = 1 THEN 1 END AS error
FROM (SELECT id, text, points FROM s) s JOIN o USING (id, text)""")
def override_fold(spark, sf_dir):
    """Three kinds of chains over suppliers: append and replace, a stale basis, replace and revoke."""
    from ..functions.hashing import fingerprint

    clauses = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"), F.col("s_acctbal").alias("points"))
    two = F.concat("text", F.lit("\nx"))
    kind = F.col("id") % 3
    step = lambda n, action, text, basis: F.struct(F.lit(n).alias("confirmed_order"), F.lit(action).alias("action"), text.alias("text"), fingerprint(basis, F.col("points")).alias("basis"))
    chains = F.when(kind == 0, F.array(step(2, "replace", F.concat(two, F.lit("!")), two), step(1, "append", F.lit("x"), F.col("text"))))
    chains = chains.when(kind == 1, F.array(step(1, "replace", F.lit("never"), F.lit("stale")))).otherwise(F.array(step(1, "replace", F.lit("new"), F.col("text")), step(2, "revoke", F.lit(""), F.lit("new"))))
    overrides = clauses.select(F.col("id").alias("clause_id"), F.explode(chains).alias("o")).select("clause_id", "o.*", F.lit("confirmed").alias("state"))
    return versions.apply_overrides(clauses, overrides)
