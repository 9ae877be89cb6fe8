"""Packages, rubrics and commitments over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clauses, commitments, rubrics
from ..sources.tables import table
from .registry import query

NUMERALS = "['一', '二', '三', '四', '五', '六', '七', '八', '九', '十']"


@query(f"""WITH p AS (SELECT p_partkey, p_partkey % 10 + 1 AS n, p_size % 3 AS form, p_partkey % 4 AS tail FROM part)
SELECT p_partkey, CASE WHEN form = 2 AND tail = 1 THEN ['B包', 'C包'] WHEN form = 2 THEN ['B包'] WHEN tail = 1 THEN [concat('包', n), 'C包'] ELSE [concat('包', n)] END AS labels, CASE WHEN tail = 1 THEN '' WHEN tail = 2 THEN NULL WHEN form = 2 THEN 'B包' ELSE concat('包', n) END AS marker FROM p""")
def package_labels(spark, sf_dir):
    """Lines such as 第三包, 包7 and b包, alone, beside another package, inside a sentence and with a title behind."""
    n = (F.col("p_partkey") % 10 + 1).cast("int")
    form = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("第"), F.element_at(F.array(*[F.lit(c) for c in rubrics.NUMERALS]), n), F.lit("包"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("包"), n)).otherwise("b包")
    tail = F.when(F.col("p_partkey") % 4 == 1, "、C包通用").when(F.col("p_partkey") % 4 == 2, "：内容。").when(F.col("p_partkey") % 4 == 3, "：服务").otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(form, tail).alias("line"))
    return rows.select("p_partkey", rubrics.package_labels(F.col("line")).alias("labels"), rubrics.package_marker(F.col("line")).alias("marker"))


@query("""WITH i AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '价格部分' WHEN 1 THEN '商务部分' WHEN 2 THEN '技术部分' ELSE '其他' END AS category, CASE p_size % 5 WHEN 0 THEN '系统演示' WHEN 1 THEN '技术偏离' WHEN 2 THEN '团队人员' WHEN 3 THEN '服务方案' ELSE 'x' END AS name, CASE WHEN p_size % 2 = 0 THEN '提供证书' ELSE 'y' END AS criteria FROM part),
k AS (SELECT *, CASE WHEN category = '价格部分' THEN 'price' WHEN category = '商务部分' THEN 'business' WHEN category = '技术部分' THEN 'technical' WHEN name = '团队人员' THEN 'business' ELSE 'other' END AS kind FROM i)
SELECT p_partkey, kind, CASE WHEN kind = 'price' THEN 'price' WHEN name = '系统演示' THEN 'demo' WHEN name = '技术偏离' THEN 'compliance' WHEN name = '团队人员' THEN 'evidence' WHEN name = '服务方案' THEN 'proposal' WHEN criteria = '提供证书' THEN 'evidence' ELSE 'proposal' END AS answer FROM k""")
def item_kinds(spark, sf_dir):
    n, size = F.col("p_partkey") % 4, F.col("p_size") % 5
    category = F.when(n == 0, "价格部分").when(n == 1, "商务部分").when(n == 2, "技术部分").otherwise("其他")
    name = F.when(size == 0, "系统演示").when(size == 1, "技术偏离").when(size == 2, "团队人员").when(size == 3, "服务方案").otherwise("x")
    rows = table(spark, sf_dir, "part").select("p_partkey", category.alias("category"), name.alias("name"), F.when(F.col("p_size") % 2 == 0, "提供证书").otherwise("y").alias("criteria")).withColumn("kind", rubrics.item_kind(F.col("category"), F.col("name")))
    return rows.select("p_partkey", "kind", rubrics.answer_kind(F.col("kind"), F.col("name"), F.col("criteria")).alias("answer"))


@query("""WITH r AS (SELECT c_custkey AS table_id, c_name, c_nationkey FROM customer), s AS (SELECT table_id, 1 AS number, '价格分' AS category, '价格评审' AS name, 10.0::DOUBLE AS points, 'price' AS kind, 'price' AS answer, 'lowest' AS criteria FROM r
UNION ALL SELECT table_id, 2, '技术部分', '服务方案', c_nationkey + 5.0::DOUBLE, 'technical', 'proposal', concat(c_name, chr(10), 'second') FROM r UNION ALL SELECT table_id, 3, '技术部分', '运维', 20.0::DOUBLE, 'technical', 'proposal', concat('first', chr(10), 'second') FROM r)
SELECT table_id, number, concat('包', c_nationkey % 9 + 1) AS package, category, name, points, kind, answer, criteria FROM s JOIN r USING (table_id)""")
def rubric_items(spark, sf_dir):
    """A scoring table for each customer: one item, one in two rows whose points add up, one in two rows that share their points, a total."""
    line = lambda *cells: F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells])
    rows = F.array(
        line("类别", "评审因素", "评分标准说明", "分值"), line("价格分", "价格评审", "lowest", "10（10，5，0）"), line("技术部分", "服务方案", F.col("c_name"), "5分"), line("技术部分", "服务方案", "second", F.col("c_nationkey").cast("string")),
        line("技术部分", "运维", "first", "20"), line("技术部分", "运维", "second", "20"), line("合计", "", F.col("c_custkey").cast("string"), "100"),
    )
    keys = F.array(*[F.array(*[F.lit(k) for k in own]) for own in ([0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [8, 9, 12, 13], [14, 15, 16, 17], [14, 15, 18, 17], [19, 20, 21, 22])])
    context = F.concat(F.lit("第"), F.col("c_nationkey") % 9 + 1, F.lit("包评分"))
    return rubrics.rubric_items(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table_id"), rows.alias("rows"), keys.alias("keys"), context.alias("context")))


@query()
def scoped_clauses(spark, sf_dir):
    """Clauses by package; conversations stand for documents of titles, labels and paragraphs. Scopes are folds that SQL cannot state."""
    turn = F.col("turn")
    kind = F.when(turn % 4 == 0, "title").otherwise("para")
    said = F.when(turn % 8 == 0, F.concat(F.lit("技术需求"), turn)).when(turn % 4 == 0, F.concat(F.lit("包"), turn % 3 + 1, F.lit("要求"))).when(turn % 7 == 1, F.concat(F.lit("第"), turn % 3 + 1, F.lit("包"))).otherwise(F.concat(F.lit("须支持 "), "text"))
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("pos"), F.when(turn % 8 == 0, 0).otherwise(1).alias("depth"), kind.alias("kind"), said.alias("text"), F.lit(None).cast("array<array<string>>").alias("grid"), clauses.usual_levels().alias("levels"))
    return rubrics.scoped_clauses(blocks)


def commitment_sections(spark, sf_dir):
    turn = F.col("turn")
    said = F.concat(F.lit("承诺"), turn + 1, F.lit("小时响应，质保"), turn % 4 + 1, F.lit("年。\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + turn).alias("section_id"), said.alias("text"))


def two_facts(spark):
    return spark.createDataFrame([("SLA", "2小时响应，质保2年", None)], "label string, text string, topic string").coalesce(1)


@query()
def section_checks(spark, sf_dir):
    """Commitments in turns of conversations against two facts; quantities are read by a fold that SQL cannot state."""
    facts = two_facts(spark)
    return commitments.check_commitments(commitment_sections(spark, sf_dir), commitments.fact_quantities(facts))


@query("""SELECT conv_id * 1000 + turn AS section_id, CAST(turn > 1 AS INT) + CAST(turn % 4 = 0 AS INT) AS blocking, CAST(turn = 0 AS INT) + CAST(turn % 4 > 1 AS INT) AS verify, turn <= 1 AND turn % 4 != 0 AS passed FROM conversations""")
def section_reports(spark, sf_dir):
    """Every turn promises hours and years, of which some are backed, some better and some worse; numbers of its own text have no unit."""
    own = commitment_sections(spark, sf_dir)
    facts = two_facts(spark)
    return commitments.section_report(own, commitments.check_commitments(own, commitments.fact_quantities(facts)))
