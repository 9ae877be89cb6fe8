"""Paragraphs of lines: measures by plain counts, the carried bit by a plain fold, and lines of several typesetters."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import layout

COLUMNS = "doc_id int, page int, pos int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, text string, width double, height double, in_table boolean"


def line(page, x0, y0, x1, text, size=10.5, height=10.5, bold=False):
    return page, float(x0), float(y0), float(x1), y0 + height, size, bold, text


def test_carried(spark):
    """The bit of every row against a fold, for rows that fix it, keep it and turn it round."""
    rng = random.Random(4)
    rows = [(k, i, rng.random() < 0.5, rng.random() < 0.5) for k in range(40) for i in range(rng.randrange(1, 40))]
    rows = [(k, i, a and i > 0, b and i > 0) for k, i, a, b in rows]
    wanted, bit = {}, False
    for k, i, no, yes in rows:
        bit = (yes if bit else no) if i else no
        wanted[k, i] = bit
    table = spark.createDataFrame(rows, "k int, i int, no boolean, yes boolean").repartition(3)
    found = table.withColumn("bit", layout.carried(table, ["k"], ["i"], "no", "yes")).collect()
    assert {(r.k, r.i): r.bit for r in found} == wanted


def goes_on(spark, lines, after, margins=(71.0, 71.0), rights=(524.0, 524.0), gaps=(10.0, 10.0)):
    """Whether the last line goes on with the ones before it, which are one paragraph."""
    names = ["page", "x0", "y0", "x1", "y1", "size", "bold", "text"]
    fields = lambda x: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, x, strict=True)], F.lit(rights[x[0]]).alias("right"), F.lit(margins[x[0]]).alias("margin"))
    before = F.struct(F.lit(lines[-2][3] if len(lines) > 1 else None).cast("double").alias("x1"))
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(names, after, strict=True)], F.lit(gaps[after[0]]).alias("gap"), F.lit(margins[after[0]]).alias("margin"), fields(lines[-1]).alias("_p"), before.alias("_b"))
    return row.select(layout.goes_on(len(lines) == 1).alias("on")).first()["on"]


def test_rules_of_paragraphs(spark):
    first = line(0, 92, 164, 524, "基于网站群现有系统架构，围绕资源信息内容呈现与视觉表达需求，开展资源信息专题的数据")
    second = line(0, 71, 194, 524, "梳理、栏目规划、页面和模板设计、开发，完成专题数据整理、加工和初始化，实现专题")
    assert goes_on(spark, [first], second, gaps=(20.0, 10.0)) and not goes_on(spark, [first], second)
    start, tail = line(0, 92, 100, 524, "本项目……"), line(0, 71, 140, 300, "适配能力，具体要求如下。")
    assert goes_on(spark, [start, line(0, 71, 120, 503, "目需确保具备面向中国疾病预防控制中心信息化环境持续演进的开发")], tail)
    assert not goes_on(spark, [start, line(0, 71, 120, 503, "目需确保具备面向中国疾病预防控制中心信息化环境持续演进的开发。")], tail)
    assert goes_on(spark, [line(0, 97.6, 430, 509.7, "可在中央政府采购网（www.zycg.gov.cn）在“单独委托")], line(0, 76.6, 444, 300, "项目”栏目或通过投标工具，免费下载招标文件。"), rights=(528.0, 528.0))
    rest = line(1, 184, 72, 400, "书实施政府优先采购。优先采购的具体规定见第四章。")
    item = "（2）非政府强制采购的节能产品或环境标志产品，依据品目清单和认证"
    assert goes_on(spark, [line(0, 139, 750, 538, item + "证")], rest, margins=(57.0, 57.0), rights=(545.0, 545.0))
    assert not goes_on(spark, [line(0, 139, 750, 538, item + "。")], rest, margins=(57.0, 57.0), rights=(545.0, 545.0))
    assert not goes_on(spark, [line(0, 138, 708, 524, "（2）在封装处加盖投标人公章，或由法定代表人签字。")], line(0, 102, 730, 524, "15.3 如果投标人未按上述要求密封及加写标记"))


@pytest.mark.parametrize(("said", "clean"), [("网 络 安 全7*24小时运维服务", "网络安全7*24小时运维服务"), ("地 址：北京市", "地址：北京市"), ("甲方： 乙方：", "甲方： 乙方："), ("张 三丰", "张 三丰"), ("共 3 页  a   b", "共3页a b"), (None, "")])
def test_cleaned(spark, said, clean):
    assert spark.createDataFrame([(said,)], "t string").select(layout.cleaned(F.col("t")).alias("c")).first()["c"] == clean


def random_pages(seed, docs=12):
    rng, out = random.Random(seed), []
    for d in range(docs):
        for page in range(rng.randrange(1, 5)):
            width, height, y = rng.choice([(595.0, 842.0), (842.0, 595.0)]) + (50.0,)
            for pos in range(rng.randrange(0, 25)):
                size = rng.choice([10.5, 10.5, 10.5, 12.0, 16.0])
                x0, x1 = rng.choice([71.0, 71.4, 92.0]), width - rng.choice([71.0, 71.0, 71.3, 80.0, 200.0, 400.0])
                y += size + rng.choice([5.0, 5.4, 8.0, 30.0])
                out.append((d, page, pos, x0, y - size, x1, y, size, False, "x" * rng.randrange(1, 40), width, height, rng.random() < 0.1))
    return out


def plain_edge(ends, body, least):
    best = [e for e in ends if sum(e - body <= x <= e for x in ends) >= least]
    return max(best) if best else None


def plain_measures(rows):
    out = {}
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        sizes = Counter()
        for r in own:
            sizes[r[7]] += len(r[9])
        body = sizes.most_common(1)[0][0]
        text = [r for r in own if abs(r[7] - body) <= 1 and not r[12]]
        gaps = {}
        for a, b in zip(text, text[1:], strict=False):
            if a[1] == b[1] and 0 <= b[4] - a[6] <= 3 * body and b[3] < a[5]:
                gaps.setdefault(a[1], Counter())[round(b[4] - a[6])] += 1
        total = sum(gaps.values(), Counter())
        for page in {r[1] for r in own}:
            width, height = next((r[10], r[11]) for r in own if r[1] == page)
            alike = [r for r in text if (r[10], r[11]) == (width, height)]
            lefts = Counter(round(r[3]) for r in alike)
            often = [x for x, n in lefts.items() if n >= max(3, 0.05 * len(alike))]
            ends = [r[5] for r in alike if len(r[9]) >= 10 and r[5] > width / 2]
            right = (plain_edge(ends, body, max(3, 0.2 * len(ends))) or max(ends)) if ends else width
            here = [r[5] for r in alike if r[1] == page and len(r[9]) >= 10 and r[5] > width / 2]
            edge = plain_edge(here, body, max(3, 0.25 * len(here))) if len(here) >= 6 else None
            samples = gaps.get(page, Counter())
            gap = samples if sum(samples.values()) >= 5 else total
            margin = min(often) if often else min(lefts, default=0)
            out[d, page] = (body, max(gap.values(), default=0), gap, margin, edge if edge is not None and edge >= right - 3 * body else right)
    return out


def test_measures(spark):
    rows = random_pages(7)
    wanted = plain_measures(rows)
    found = {(r.doc_id, r.page): r for r in layout.page_measures(spark.createDataFrame(rows, COLUMNS).repartition(4)).collect()}
    assert found.keys() == wanted.keys()
    for key, (body, most, gap, margin, right) in wanted.items():
        r = found[key]
        assert (r.body, r.margin, r.right) == (body, margin, right), key
        assert gap[r.gap] == most if gap else r.gap == 0  # a mode


def test_paragraphs(spark):
    lines = [
        line(0, 92, 100, 524, "本项目采用分层架构设计，由接入层、服务层和数据层组成，各层之间通过接口"), line(0, 71, 120, 524, "进行交互，保证系统的可扩展性和可维护性，满足后续业务发展的需要并且支持"), line(0, 71, 140, 300, "web api 调用。"),
        line(0, 92, 160, 300, "（1）第一项。"), line(0, 92, 180, 524, "第二段的首行写满了整个版心宽度并且没有结束，所以它的下一行应当是同一段的"), line(1, 71, 80, 200, "续 行。"), line(1, 92, 100, 250, "新的一段。"),
    ]
    filler = [(2, page, 100 + k, 71.0, 300.0 + 20 * k, 524.0, 310.5 + 20 * k, 10.5, False, "x" * 40, 595.0, 842.0, False) for page in (0, 1) for k in range(8)]
    rows = [(1, x[0], i, *x[1:3], x[3], x[4], x[5], x[6], x[7], 595.0, 842.0, False) for i, x in enumerate(lines)] + filler
    found = [(r.page, r.lines, r.text) for r in layout.paragraphs(spark.createDataFrame(rows, COLUMNS).repartition(3)).filter("doc_id = 1").orderBy("paragraph").collect()]
    assert found == [
        (0, 3, "本项目采用分层架构设计，由接入层、服务层和数据层组成，各层之间通过接口进行交互，保证系统的可扩展性和可维护性，满足后续业务发展的需要并且支持web api 调用。".replace("api 调", "api调")),
        (0, 1, "（1）第一项。"), (0, 2, "第二段的首行写满了整个版心宽度并且没有结束，所以它的下一行应当是同一段的续 行。"), (1, 1, "新的一段。"),
    ]
    assert layout.paragraphs(spark.createDataFrame([], COLUMNS)).count() == 0


def test_lines_are_cut_once(spark):
    """Measures come from lines written without texts, so a plan reads the lines themselves once; a paragraph of many lines is put together by their ends."""
    n = 3000
    rows = [(1, k // 50, k % 50, 71.0, 15.0 * (k % 50), 524.0, 15.0 * (k % 50) + 10.5, 10.5, False, "words that go on and on to the edge" if k % 7 else " ", 595.0, 842.0, False) for k in range(n)]
    found = layout.paragraphs(spark.createDataFrame(rows, COLUMNS))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    said = [(r.lines, r.text) for r in found.orderBy("paragraph").collect()]
    assert sum(k for k, _ in said) == n and max(len(t) for _, t in said) > 1000
    assert all(t == " ".join(["words that go on and on to the edge"] * ((len(t) + 1) // 36)) for _, t in said)
