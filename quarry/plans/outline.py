"""Chapters from scoring items, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outline
from ..sources.tables import table
from .registry import query

ITEMS = """SELECT p_size AS project, p_partkey AS pos, p_partkey AS item_id, p_name AS name, CASE p_partkey % 6 WHEN 0 THEN 'compliance' WHEN 1 THEN 'demo' WHEN 2 THEN 'evidence' WHEN 3 THEN 'price' ELSE 'proposal' END AS answer,
concat('包', p_partkey % 3) AS package, CASE WHEN p_size % 4 = 0 THEN '包9' ELSE concat('包', p_size % 3) END AS target FROM part"""
CHAPTERS = """(SELECT project, 0 AS kind, pos AS spot, name AS title, [item_id] AS item_ids FROM {0} WHERE answer = 'proposal' UNION ALL
SELECT project, k.kind, 0, CASE WHEN answer = 'demo' AND count(*) = 1 THEN min(name) ELSE k.title END, list(item_id ORDER BY pos) FROM {0} JOIN (VALUES ('compliance', 1, '技术需求逐条响应'), ('demo', 2, '现场演示方案'), ('evidence', 3, '商务资信与证明材料')) k(answer, kind, title) USING (answer) GROUP BY project, answer, k.kind, k.title)"""


def item_rows(spark, sf_dir):
    n = F.col("p_partkey")
    answer = F.when(n % 6 == 0, "compliance").when(n % 6 == 1, "demo").when(n % 6 == 2, "evidence").when(n % 6 == 3, "price").otherwise("proposal")
    return table(spark, sf_dir, "part").select(
        F.col("p_size").alias("project"), n.alias("pos"), n.alias("item_id"), F.col("p_name").alias("name"), answer.alias("answer"), F.concat(F.lit("包"), n % 3).alias("package"),
        F.when(F.col("p_size") % 4 == 0, "包9").otherwise(F.concat(F.lit("包"), F.col("p_size") % 3)).alias("target"),
    )


@query(f"""WITH i AS ({ITEMS}), p AS (SELECT project, coalesce(max(package) FILTER (package = target), arg_min(package, pos)) AS chosen FROM i GROUP BY 1) SELECT project, item_id, package FROM i JOIN p USING (project) WHERE package = chosen AND answer != 'price'""")
def target_items(spark, sf_dir):
    return outline.target_items(item_rows(spark, sf_dir)).select("project", "item_id", "package")


@query("""SELECT p_partkey, concat('评分项：', p_name, '（', p_size, '分）') AS first, CASE WHEN p_partkey % 3 = 0 THEN [concat('须覆盖：', p_brand)] ELSE ['须覆盖：进度计划', concat('须覆盖：', p_type)] END AS covered, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS more FROM part""")
def item_requirements(spark, sf_dir):
    n = F.col("p_partkey")
    parts = F.when(n % 3 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    criteria = F.concat(F.lit("内容包括：①进度计划；②"), "p_type", F.lit("。上述内容完整"), F.when(n % 5 == 0, "，无瑕疵").otherwise(""))
    asked = outline.item_requirements(F.col("p_name"), F.col("p_size").cast("double"), parts, criteria, F.when(n % 2 == 0, "evidence").otherwise("proposal"), F.lit("证书复印件"))
    rows = table(spark, sf_dir, "part").select("p_partkey", asked.alias("asked"))
    covered = F.filter("asked", lambda a: F.startswith(a, F.lit(outline.COVER)))
    return rows.select("p_partkey", F.get("asked", F.lit(0)).alias("first"), covered.alias("covered"), (F.size("asked") - 1 - F.size(covered)).alias("more"))


@query(f"WITH i AS ({ITEMS}), c AS {CHAPTERS.format('i')} SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY kind, spot) AS INT) AS number, title, item_ids FROM c")
def rubric_chapters(spark, sf_dir):
    rows = outline.numbered(outline.rubric_chapters(item_rows(spark, sf_dir)))
    return rows.withColumn("title", F.regexp_replace("title", outline.CHAPTER, ""))


@query(f"""WITH i AS ({ITEMS}), d AS (SELECT project, min(pos) AS place, concat('own ', project) AS title, [min(item_id), max(item_id)] AS ids FROM i WHERE answer != 'price' GROUP BY project), m AS (SELECT i.* FROM i JOIN d USING (project) WHERE NOT list_contains(ids, item_id)),
c AS (SELECT project, -1 AS kind, place AS spot, title, ids AS item_ids FROM d UNION ALL SELECT * FROM {CHAPTERS.format('m')}) SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY kind, spot) AS INT) AS number, title, item_ids FROM c""")
def covering_chapters(spark, sf_dir):
    """A drafted chapter for each project with two of its items and one that it does not know; the rest is appended."""
    items = item_rows(spark, sf_dir)
    drafted = items.filter("answer != 'price'").groupBy("project").agg(F.min("pos").alias("place"), F.array(F.min("item_id"), F.lit(-1).cast("long"), F.max("item_id")).alias("item_ids")).withColumn("title", F.concat(F.lit("own "), "project"))
    known = items.join(drafted.select("project"), "project", "left_semi")
    rows = outline.numbered(outline.covering(drafted, known))
    return rows.withColumn("title", F.regexp_replace("title", outline.CHAPTER, ""))
