"""Tables over pages, bookmarks and flow charts."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import bookmarks, diagrams, tables

BLOCK = "doc_id int, seq int, page int, edges array<double>, first_on_page boolean, last_on_page boolean"
ROW = "doc_id int, seq int, r int, cells array<struct<text:string,cut:boolean,bottom:boolean,strong:boolean>>"


def test_stitched(spark):
    """Against a plain pass: edges are held against the head's, so they may not drift; a paragraph between parts tables."""
    rng, rows, wanted = random.Random(1), [], {}
    for d in range(30):
        head = before = None
        for seq in range(rng.randrange(1, 12)):
            edges = None if rng.random() < 0.2 else [50.0 + rng.choice([0, 2, 4]), 100.0 + rng.choice([0, 2])] + [200.0] * (rng.random() < 0.1)
            block = (d, seq, seq if rng.random() < 0.8 else seq + 1, edges, rng.random() < 0.8, rng.random() < 0.8)
            rows.append(block)
            if edges:
                goes_on = before and before[3] and block[2] == before[2] + 1 and before[5] and block[4] and len(head[3]) == len(edges) and all(abs(a - b) <= 3 for a, b in zip(head[3], edges, strict=True))
                head = head if goes_on else block
                wanted[d, seq] = head[1]
            before = block
    found = tables.stitched(spark.createDataFrame(rows, BLOCK).repartition(3)).collect()
    assert {(r.doc_id, r.seq): r.head for r in found} == wanted and len(set(wanted.items())) > 30


def cell(text, cut=False, bottom=False, strong=False):
    return text, cut, bottom, strong


def joined(spark, *parts):
    """Rows of tables of one document, each on a page of its own, joined."""
    rows = [(1, seq, r, [c if isinstance(c, tuple) else cell(c) for c in row]) for seq, part in enumerate(parts) for r, row in enumerate(part)]
    heads = spark.createDataFrame([(1, seq, 0) for seq in range(len(parts))], "doc_id int, seq int, head int")
    found = tables.joined_rows(spark.createDataFrame(rows, ROW), heads).orderBy("row").collect()
    assert [r.row for r in found] == list(range(len(found)))
    return [r.cells for r in found]


@pytest.mark.parametrize("strong", [True, False])
def test_row_cut_in_a_cell(spark, strong):
    first = [["技术部分（77分）", cell("安全保密管理措施和技", True, True, strong), cell("供应商提供对本项目的保密承诺，得1分，否则得0分。", False, True), "1"]]
    rest = [["", "术方案", "注：供应商应提供保密承诺函，并加盖公章。", ""]]
    whole = ["技术部分（77分）", "安全保密管理措施和技术方案", "供应商提供对本项目的保密承诺，得1分，否则得0分。 注：供应商应提供保密承诺函，并加盖公章。", "1"]
    apart = [["技术部分（77分）", "安全保密管理措施和技", "供应商提供对本项目的保密承诺，得1分，否则得0分。", "1"], ["技术部分（77分）", "术方案", "注：供应商应提供保密承诺函，并加盖公章。", "1"]]
    assert joined(spark, first, rest) == ([whole] if strong else apart)


def test_rows_over_three_pages(spark):
    """Heads that are repeated go; a row may run over several pages; a new row stays one; empty rows go."""
    head = ["名称", "要求"]
    assert joined(spark, [head, ["a", cell("one", True)]], [head, ["", cell("two", True)]], [head, ["", "three"], ["b", "four"], ["", ""]]) == [head, ["a", "one two three"], ["b", "four"]]
    assert joined(spark, [head, ["a", "done"]], [["b", "new"]]) == [head, ["a", "done"], ["b", "new"]]
    assert joined(spark, [head, ["a", "done"]], [["", "more"]]) == [head, ["a", "done"], ["a", "more"]]


def test_tasks_follow_rows(spark, monkeypatch):
    """Rows are dealt out by their number, not by the session's partitions, also under a head that is a constant; columns that a row above has not are passed over."""
    monkeypatch.setattr(tables, "TASK_ROWS", 5)
    parts = [[["h", "k"], ["a", "b"]], [["h", "k"], ["c"], ["d", "e"]], [["", ""], ["f", "g"]]]
    rows = [(d, seq, r, [cell(c) for c in row]) for d in range(9) for seq, part in enumerate(parts) for r, row in enumerate(part)]
    blocks = spark.createDataFrame([(d, seq) for d in range(9) for seq in range(3)], "doc_id int, seq int")
    found = tables.joined_rows(spark.createDataFrame(rows, ROW), blocks.withColumn("head", F.lit(0)))
    assert found.rdd.getNumPartitions() == 13  # 63 rows
    assert {r.doc_id: r.cells for r in found.filter("row = 3").collect()} == {d: ["d", "e"] for d in range(9)}
    assert [r.cells for r in found.filter("doc_id = 3").orderBy("row").collect()] == [["h", "k"], ["a", "b"], ["c"], ["d", "e"], ["f", "g"]]


PARAGRAPH = "doc_id int, paragraph int, page int, lines int, text string"
MARK = "doc_id int, k int, level int, title string, page int"


def test_bookmarks(spark):
    """In order, past the same title in the contents; a wrapped title; a title that is nowhere."""
    texts = [(0, 1, "目录"), (1, 1, "第一章 投标邀请"), (1, 1, "第二章 项目需求"), (3, 1, "第一章 投标邀请"), (3, 5, "正文。"), (4, 1, "第二章 项目"), (4, 1, "一、概念·释义"), (5, 2, "其他")]
    rows = [(1, i, page, n, t) for i, (page, n, t) in enumerate(texts)]
    marks = [(1, 0, 1, "第一章 投标邀请", 4), (1, 1, 1, "第二章 项目需求", 5), (1, 2, 2, "一、概念释义", 5), (1, 3, 1, "没有", 5), (1, 4, 1, "·", 5), (2, 0, 1, "第一章 投标邀请", 1)]
    found = bookmarks.headings(spark.createDataFrame(marks, MARK), spark.createDataFrame(rows, PARAGRAPH)).orderBy("paragraph").collect()
    assert [(r.doc_id, r.paragraph, r.level) for r in found] == [(1, 3, 1), (1, 5, 1), (1, 6, 2)]


def test_bookmarks_that_miss_chapters(spark):
    """Of six chapters only one is marked: turned down; four of six: kept."""
    texts = [f"第{n}章 内容{n}" for n in "一二三四五六"] + ["（1）平台对接", "一、投标人应答索引表", "附件"]
    paragraphs = spark.createDataFrame([(d, i, 0, 1, t) for d in (1, 2) for i, t in enumerate(texts)], PARAGRAPH)
    found = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7), *[(2, i, i) for i in (0, 1, 2, 3)], (2, 4, 7)], "doc_id int, k int, paragraph int")
    assert {r.doc_id for r in bookmarks.covering(found, paragraphs).collect()} == {2}


def graph(size):
    lines = ["graph TD"]
    for start in range(0, size, 5):
        lines += [f"subgraph 逻辑层{start // 5 + 1}", *[f"N{i}[业务节点{i + 1}]" for i in range(start, min(size, start + 5))], "end"]
    return "\n".join(lines + [f"N{i} --> N{i + 1}" for i in range(size - 1)])


def test_parts_keep_nodes_and_cross_edges(spark):
    codes = [(30, graph(30)), (60, graph(60)), (10, graph(10)), (7, "flowchart LR\n" + "\n".join(f"a{i} --> a{i + 1}" for i in range(14)))]
    nodes, edges, read = diagrams.parsed(spark.createDataFrame(codes, "diagram_id int, code string"))
    placed, crossing = diagrams.parts(nodes, edges)
    placed, crossing = placed.collect(), crossing.collect()
    count = lambda k: len({r.part for r in placed if r.diagram_id == k})
    assert (count(30), count(60), count(10), count(7)) == (6, 12, 1, 3)
    assert sum(r.diagram_id == 60 for r in placed) == 60 and sum(r.diagram_id == 60 for r in crossing) == 59
    assert sum(not r.inner for r in crossing if r.diagram_id == 60) == 11 and all(r.label == f"业务节点{int(r.ident[1:]) + 1}" for r in placed if r.ident[0] == "N")
    assert {r.diagram_id: (r.nodes, r.dense) for r in diagrams.checks(nodes, read).collect()} == {30: (30, True), 60: (60, True), 10: (10, False), 7: (15, True)}


def test_forms_of_charts(spark):
    codes = [
        (1, '---\ntitle: x\n---\ngraph LR;\n%% note\nA["one"] -->|yes| B(two) --> C{three};\nA[last]\nC'), (2, "sequenceDiagram\nA->>B: x"), (3, "graph TD\nsubgraph g\nA"), (4, "graph TD\nA\nend"), (5, "graph TD\nstyle A fill:#fff\nA"),
        (6, "graph TD\nA{{x}}"), (7, None), (8, "graph TD"), (9, "graph TD\nsubgraph outer\nA\nsubgraph inner\nB\nend\nC\nend\nB --> D[" + "长" * 30 + "]"),
    ]
    nodes, edges, read = diagrams.parsed(spark.createDataFrame(codes, "diagram_id int, code string"))
    assert {r.diagram_id for r in read.filter("readable").collect()} == {1, 9}
    found = {(r.diagram_id, r.ident): (r.label, r.group) for r in nodes.collect()}
    assert found == {(1, "A"): ("last", None), (1, "B"): ("two", None), (1, "C"): ("three", None), (9, "A"): ("A", "outer"), (9, "B"): ("B", "inner"), (9, "C"): ("C", "outer"), (9, "D"): ("长" * 30, None)}
    assert sorted((r.diagram_id, r["from"], r.to, r.label) for r in edges.collect()) == [(1, "A", "B", "yes"), (1, "B", "C", ""), (9, "B", "D", "")]
    assert {r.diagram_id for r in diagrams.checks(nodes, read).filter("long_labels").collect()} == {9}


def test_bookmark_chains_are_no_groups_of_pandas(spark):
    """The pairs of a document are one list, so that chains of many documents are found in one batch."""
    own = spark.createDataFrame([(d, p, 0, 1, f"line {p}") for d in (1, 2) for p in range(4)], "doc_id long, paragraph int, page int, lines int, text string")
    marks = own.selectExpr("doc_id", "paragraph AS k", "1 AS level", "text AS title", "page + 1 AS page")
    found = bookmarks.matched(marks, own)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(d, p, p) for d in (1, 2) for p in range(4)]
