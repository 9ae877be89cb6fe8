"""Claims, wording and the report on sections, on turns of conversations with sentences put in front."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import CLICHES, WEAK_PHRASES
from ..operators import claims, commitments
from ..operators.intervals import sorted_join
from ..sources.tables import table
from .registry import query
from .rubrics import commitment_sections, two_facts

# A sentence for each remainder of the turn, and where its claims are.
SENTENCES = [
    ("本项目成员全部为直接聘用并依法缴纳社会保险的在职员工。", [[8, 12]]), ("成员为【在职员工：待核实】，补齐。", []), ("中标后签订劳动合同并依法缴纳社会保险。", []),
    ("专职员工到岗【待核实】。正式在职，自有人员！在职人员。", [[12, 16], [17, 21], [22, 26]]), ("签订！劳动合同。", [[0, 7]]), ("", []),
]
SAID = "CASE turn % 6 " + " ".join(f"WHEN {k} THEN '{text}'" for k, (text, _) in enumerate(SENTENCES)) + " END"
PLACES = "CASE turn % 6 " + " ".join(f"WHEN {k} THEN {places or 'CAST([] AS INT[][])'}" for k, (_, places) in enumerate(SENTENCES)) + " END"
SECTION = "conv_id * 1000 + turn AS section_id"


def sentence():
    return F.element_at(F.array(*[F.lit(text) for text, _ in SENTENCES]), (F.col("turn") % 6 + 1).cast("int"))


def turns(spark, sf_dir):
    said = F.concat(sentence(), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("section_id"), "turn", "role", said.alias("text"))


@query(f"""SELECT section_id, CAST(p[1] AS BIGINT) AS start, CAST(p[2] AS BIGINT) AS "end" FROM (SELECT {SECTION}, unnest({PLACES}) AS p FROM conversations)""")
def staff_claims(spark, sf_dir):
    return claims.staff_claims(turns(spark, sf_dir))


HEADED = "concat(CASE turn % 4 WHEN 1 THEN concat('# 小标题', chr(10)) WHEN 2 THEN '大概可能' ELSE '' END, text)"
FOUND = " + ".join(f"length(regexp_extract_all(said, '{p}'))" for p in CLICHES)
WEAK = " + ".join(f"(length(said) - length(replace(said, '{p}', ''))) / {len(p)}" for p in WEAK_PHRASES)


@query(f"""WITH s AS (SELECT {SECTION}, {HEADED} AS said FROM conversations), c AS (SELECT section_id, 'markdown_heading' AS code, length(regexp_extract_all(said, '(?m)^[ \\t]*#{{1,6}}[ \\t]+[^ \\t\\n].*$')) AS n FROM s
UNION ALL SELECT section_id, 'cliche', {FOUND} FROM s UNION ALL SELECT section_id, 'weak_phrase', {WEAK} FROM s) SELECT section_id, code, CAST(n AS BIGINT) AS n FROM c WHERE n > 0""")
def section_wording(spark, sf_dir):
    front = F.when(F.col("turn") % 4 == 1, "# 小标题\n").when(F.col("turn") % 4 == 2, "大概可能").otherwise("")
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("section_id"), F.concat(front, "text").alias("text"))
    return claims.wording(rows).groupBy("section_id", "code").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT {SECTION}, turn, len({PLACES}) AS n FROM conversations), r AS (SELECT section_id, n + CAST(turn > 1 AS INT) + CAST(turn % 4 = 0 AS INT) + 1 + CAST(turn % 2 = 0 AS INT) AS blocking, CAST(turn = 0 AS INT) + CAST(turn % 4 > 1 AS INT) + CAST(turn % 6 IN (1, 3) AS INT) AS verify FROM s)
SELECT section_id, CAST(blocking AS BIGINT) AS blocking, CAST(verify AS BIGINT) AS verify, false AS passed FROM r""")
def section_check(spark, sf_dir):
    """Claims, commitments against two facts, an example asset named in every section, and a point that every second section lacks."""
    own = sorted_join(turns(spark, sf_dir).select("section_id", "turn", "role", sentence().alias("front")), commitment_sections(spark, sf_dir), "section_id")
    sections = own.select("section_id", F.col("role").alias("title"), F.concat("front", "text").alias("text"), F.lit(None).cast("int").alias("budget"), F.lit(None).cast("int").alias("diagram_budget"))
    assets = spark.createDataFrame([("x", "小时响应", "example", "cases"), ("y", "质保", "confirmed", "cases"), ("z", "质保", "example", "cases")], "asset_id string, identifier string, status string, kind string")
    points = own.select("section_id", F.explode(F.when(F.col("turn") % 2 == 0, F.array(F.lit("应急预案"), F.lit("小时响应"))).otherwise(F.array(F.lit("小时响应")))).alias("point"))
    facts = commitments.fact_quantities(two_facts(spark))
    issues = claims.section_issues(sections, assets, points, commitments.check_commitments(sections, facts))
    return claims.report(sections, issues).select("section_id", "blocking", "verify", "passed")
