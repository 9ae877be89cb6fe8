"""Interval joins, claims, marks, assets and the report on sections against plain scans."""

import random
import re

from quarry import plans
from quarry.operators import claims as c
from quarry.operators import intervals

ENDS = re.compile("[，,。；;！!？?\n]")
MARK = re.compile("【[^【】]{0,60}待核实[^【】]{0,60}】")


def test_overlaps(spark):
    """Points, short and very long intervals, empty ones, ties and repeated rows; every pair once."""
    rng = random.Random(1)
    side = lambda n: [(rng.randrange(3), a := rng.randrange(3000), a + rng.choice([0, 1, 5, 17, 300, 2000, 10**6])) for _ in range(n)] + [(1, 5, 9), (1, 5, 9)]
    a, b = side(80), side(90)
    left = spark.createDataFrame([(*r, i) for i, r in enumerate(a)], "k int, start long, end long, i int")
    right = spark.createDataFrame([(*r, i) for i, r in enumerate(b)], "k int, `from` long, to long, j int")
    found = sorted((r.i, r.j) for r in intervals.overlaps(left, right, ["k"]).collect())
    assert found == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2]) and x[1] < x[2] and y[1] < y[2])
    assert intervals.overlaps(left.limit(0), right, ["k"]).count() == 0


def bounds(text, start, end):
    a, b = start, end
    while a and not ENDS.match(text[a - 1]):
        a -= 1
    while b < len(text) and not ENDS.match(text[b]):
        b += 1
    return a, b


def is_marked(text, start, end):
    if any(m.start() <= start and end <= m.end() for m in MARK.finditer(text)):
        return True
    stop = re.search("[。；;\n]", text[end:])
    limit = min(bounds(text, start, end)[1] + 40, end + stop.start() if stop else len(text))
    return MARK.search(text[end:limit]) is not None


def plain_claims(text):
    out, last = [], (-1, -1)
    for m in re.finditer(c.STAFF_CLAIM, text):
        a, b = bounds(text, m.start(), m.end())
        if (a < last[1] and b > last[0]) or is_marked(text, m.start(), m.end()) or re.compile(c.STAFF_PLAN).search(text, a, b):
            continue
        last = (a, b)
        out.append((m.start(), m.end()))
    return out


BITS = ["直接聘用", "依法缴纳社会保险", "在职员工", "签订", "劳动合同", "签订！劳动合同", "拟派", "中标后", "【待核实】", "【人员：待核实】", "【待填写】", "，", "。", "；", "\n", "！", "人员", "负责" * 12, "a, b"]


def random_texts(seed, n):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 25)))) for i in range(n)] + [(10_000, None), (10_001, ""), (10_002, "本项目成员全部为投标人直接聘用并依法缴纳社会保险的在职员工。" * 40)]


def test_staff_claims(spark):
    texts = random_texts(2, 400)
    found = {}
    for r in c.staff_claims(spark.createDataFrame(texts, "section_id long, text string").repartition(3)).collect():
        found.setdefault(r.section_id, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in found.items()} == {k: x for k, t in texts if (x := plain_claims(t or ""))}


def test_claims_of_the_rule(spark):
    texts = [(1, "本项目成员全部为投标人直接聘用并依法缴纳社会保险的在职员工。"), (2, "成员名单及用工情况为【在职员工与社保缴纳情况：待核实】，投标前补齐证明。"), (3, "中标后与全体项目成员签订劳动合同并依法缴纳社会保险。")]
    assert [r.section_id for r in c.staff_claims(spark.createDataFrame(texts, "section_id long, text string")).collect()] == [1]


def test_assets(spark):
    """One report a place; a mark in the next paragraph confirms nothing; users' own assets hide examples of the same name."""
    texts = [(1, "持有ISO9001。\n证明文件为ISO9001。"), (2, "王工负责实施\n【待核实：王工】任项目经理"), (3, "张 三负责，李四负责【待核实】"), (4, None)]
    assets = [("q", "ISO9001", "example"), ("q", "ISO9001", "example"), ("p", "王工", "unverified"), ("e", "张三", "example"), ("u", "张三", "confirmed"), ("l", "李四", "unverified"), ("l", "李四负责", "unverified"), ("x", "王", "example")]
    found = c.asset_mentions(spark.createDataFrame(texts, "section_id long, text string"), spark.createDataFrame(assets, "asset_id string, identifier string, status string"))
    assert sorted((r.section_id, r.start, r.asset_id, r.code) for r in found.collect()) == [
        (1, 2, "q", "example_asset"), (1, 16, "q", "example_asset"), (2, 0, "p", "unmarked_unverified"), (2, 12, "p", "to_verify"), (3, 6, "l", "to_verify"),
    ]


def test_report(spark):
    rows = [
        (1, "1.2 安全与运维", "## 1.2 安全与运维\n众所周知，数据安全保障很重要。\n# 小标题\n运维服务体系基本上满足要求。", 100, None), (2, "人员", "我方（【投标人全称：待填写】）直接聘用。", 0, None), (3, "空", "  ", 5, None),
        (4, "图", "```mermaid\ngraph TD\n大概\n```\n进度计划【待填写】，工期【待填写】", None, 5),
    ]
    sections = spark.createDataFrame(rows, "section_id long, title string, text string, budget int, diagram_budget int")
    assets = spark.createDataFrame([("a", "甲乙", "example", "cases")], "asset_id string, identifier string, status string, kind string")
    points = spark.createDataFrame([(4, "进度计划"), (4, "质量保障措施"), (2, "人员")], "section_id long, point string")
    issues = c.section_issues(sections, assets, points).collect()
    codes = lambda k: sorted(r.code for r in issues if r.section_id == k)
    assert codes(1) == ["cliche", "length", "markdown_heading", "markdown_heading", "title_repeat", "weak_phrase"]
    assert codes(2) == ["employment_claim", "placeholder"] and codes(3) == ["empty"]
    assert codes(4) == ["diagram_length", "missing_point", "placeholder", "placeholder"]
    items = {r.item for r in c.placeholders(sections).collect() if r.section_id == 4}
    assert items == {"进度计划【待填写】", "工期【待填写】"}
    table = spark.createDataFrame(issues, "section_id long, level string, code string, start long, excerpt string, line int")
    found = {r.section_id: (r.blocking, r.quality, r.verify, r.passed) for r in c.report(sections, table).collect()}
    assert found == {1: (0, 6, 0, True), 2: (1, 0, 1, False), 3: (1, 0, 0, False), 4: (1, 1, 2, False)}
    staff = assets.union(spark.createDataFrame([("p", "王工", "confirmed", "personnel")], assets.schema))
    assert not any(r.code == "employment_claim" for r in c.section_issues(sections, staff, points).collect())


def test_sections_are_not_broadcast(spark, sf_dir):
    """Places and texts of sections meet by sorting: their small files of many rows are not gathered on the driver."""
    plan = plans.QUERIES["section_check"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [section_id" in plan and "BroadcastHashJoin [section_id" not in plan
