"""Every registered query against its SQL, and small fixtures for what SQL on the tables does not reach."""

import pytest
from pyspark.sql import functions as F

from quarry import plans
from quarry.plans import streams
from quarry.functions import numbers, text
from quarry.operators import checks, chunks, coverage, lines, matching, quantities, ranks, retrieval, trees, usage, versions
from quarry.streaming import windows
from tests.harness import differences


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.SQL:
        assert differences(df, sf_dir, plans.SQL[name]) is None
    else:
        df.collect()


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return row.select(column.alias("r")).first()["r"]


def test_body_chars(spark):
    sample = "# Title\n- item **one**\n| a | b |\n|---|:---:|\n```mermaid\nA-->B\n```\nend　 x\n```open"
    assert one(spark, text.body_chars(F.col("t")), t=sample) == len("Titleitemoneabendx")
    assert one(spark, text.diagram_chars(F.col("t")), t=sample) == len("```mermaidA-->B```")
    assert one(spark, text.body_chars(F.lit(None).cast("string"))) == 0


@pytest.mark.parametrize(
    ("cell", "name", "points"),
    [("服务方案（50分）", "服务方案", 50.0), ("20分", "", 20.0), ("方案 12.5", "方案", 12.5), ("无分值", "无分值", None), ("", "", None), ("名称：30 分", "名称", 30.0), ("10（10，5，0）", "", 10.0), ("服务 方案 20分", "服务方案", 20.0)],
)
def test_points_cell(spark, cell, name, points):
    r = one(spark, numbers.points_cell(F.col("c")), c=cell)
    assert (r.name, r.points) == (name, points)


@pytest.mark.parametrize(
    ("value", "end", "day"), [("2026年11月4日", False, "2026-11-04"), ("至 2026.2", True, "2026-02-28"), ("2026/2", False, "2026-02-01"), ("2026-13-40", False, None), ("soon", True, None)]
)
def test_parse_date(spark, value, end, day):
    r = one(spark, numbers.parse_date(F.col("v"), end), v=value)
    assert (r.isoformat() if r else None) == day


def test_matching(spark):
    point = lambda p, t: one(spark, matching.point_overlap(F.col("p"), F.col("t")), p=p, t=t)
    assert point("软、硬件的运维方案", "提供软件运维方案与硬件运维方案") >= 0.7
    assert point("运维体系", "运维服务体系建设") == 1.0 and point("应急预案", "完全无关") == 0.0
    assert one(spark, matching.code_ok(F.col("p"), F.col("t")), p="ISO9001体系", t="已获 ISO 9001 证书") and not one(spark, matching.code_ok(F.col("p"), F.col("t")), p="ISO9001", t="ISO27001")
    assert one(spark, matching.codes(F.col("p")), p="2024，CMMI，27001") == ["27001", "CMMI"]


def test_content_points(spark):
    points = one(spark, coverage.content_points(F.col("c")), c="评审内容包括： ①进度计划； ②质量保障等； ③进度计划。上述内容完整得分")
    assert points == ["进度计划", "质量保障"]
    assert one(spark, coverage.content_points(F.col("c")), c="无列举") == []
    assert one(spark, coverage.content_points(F.col("c")), c="演示内容 1.登录功能演示 2、 报表方案，其他") == ["登录功能演示", "报表方案"]
    assert one(spark, coverage.content_points(F.col("c")), c="系统应包括工单管理、任务管理、库等功能") == ["工单管理", "任务管理"]
    assert one(spark, coverage.content_points(F.col("c")), c="包括工单管理等功能") == []


def test_quarters_of_rank(spark):
    rows = spark.createDataFrame([(k, float(v)) for k in (1, 2) for v in range(k * 7)] + [(3, None), (3, 5.0), (4, 2.0), (4, 2.0), (4, 2.0)], "k int, v double")
    got = {r.k: r.v for r in ranks.nearest_rank(rows, ["k"], "v", 0.95).collect()}
    assert got == {1: 5.0, 2: 12.0, 3: None, 4: 2.0}
    assert [tuple(r) for r in ranks.nearest_rank(rows.limit(0), [], "v", 0.95).collect()] == [(None,)]


def test_tokens_cut_ideographs(spark):
    assert one(spark, retrieval.tokens(F.col("t")), t="Hello 系统架构, x1") == ["hello", "系统", "统架", "架构", "x1"]


def test_closure_and_cycle(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "gone")], "id string, parent_id string")
    assert {(r.id, r.ancestor, r.distance) for r in trees.closure(nodes).collect()} >= {("d", "a", 3), ("d", "d", 0), ("e", "e", 0)}
    with pytest.raises(ValueError, match="cycle"):
        trees.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string"))


def test_noise(spark):
    rows = [(1, i, t) for i, t in enumerate(["第 3 页 共 9 页", "目录" + "." * 8 + "3", "head", "head", "head", "head", "3 / 9", "", "a" * 41, "a" * 41, "a" * 41, "a" * 41])]
    kept = lines.without_noise(spark.createDataFrame(rows, "doc_id int, pos int, line string"))
    assert sorted(r.pos for r in kept.collect()) == [2, 3, 4, 8, 9, 10, 11]
    docs = spark.createDataFrame([(1, "\n".join(t for _, _, t in rows)), (2, None)], "doc_id int, text string")
    assert {r.doc_id: [x.pos for x in r.kept] for r in lines.kept_lines(docs).collect()} == {1: [2, 3, 4, 8, 9, 10, 11], 2: []}


def test_status_and_policy(spark):
    status = lambda *a: one(spark, usage.call_status(*[F.lit(x) for x in a]))
    assert [status(True, "e", "", ""), status(False, "e", "length", ""), status(False, "", "length", ""), status(False, "", "stop", " "), status(False, "", "stop", "x")] == ["aborted", "error", "truncated", "empty", "ok"]
    reports = [(1, 0, 2, 5, 100, 100), (1, 1, 0, 1, 100, 100), (2, 0, 1, 9, 100, 100), (3, 0, 0, 0, 200, 100)]
    got = {r.section_id: (r.kind, r.mode) for r in checks.revision_policy(spark.createDataFrame(reports, "section_id int, round int, blocking int, quality int, chars int, budget int")).collect()}
    assert got == {1: ("accept", None), 2: ("revise", "normal"), 3: ("revise", "compress")}


def test_lineage_stops_at_another_origin(spark):
    rows = spark.createDataFrame([(1, None, "x", 1), (2, 1, "y", 1), (3, 2, "y", 1)], "id int, parent_id int, origin string, section_id int")
    assert {(r.id, r.depth) for r in versions.lineage(rows, rows.filter("id = 3").select("id")).collect()} == {(3, 0), (2, 1)}


@pytest.mark.parametrize(
    ("said", "found"),
    [
        ("承诺2小时内响应", [("response", "minute", 120.0)]), ("质保期三年", [("warranty", "day", 1095.0)]), ("4小时内到达现场响应", [("onsite", "minute", 240.0)]), ("工期90日历天", [("duration", "day", 90.0)]),
        ("2026年第2年10月1日", []), ("从业6年", []), ("提供7×24小时服务", [("window", "window", 168.0)]), ("驻场两名", [("staff", "person", 2.0)]), ("一百二十天交付", [("duration", "day", 120.0)]), ("故障半天内修复", [("resolve", "minute", 720.0)]), ("开展一次巡检", [(None, "times", 1.0)]), ("每季度巡检两次", [("inspection", "times", 2 / 90)]),
        ("91500108MA61U8X2XK", []),
    ],
)
def test_quantities(said, found):
    assert [(q["topic"], q["dimension"], q["number"]) for q in quantities.quantities(said)] == found


def test_quantity_context():
    labels = {"scope": ["市区", "郊区"], "subject": [], "severity": []}
    got = [(q["severity"], q["scope"], q["comparator"], q["value"]) for q in quantities.quantities("一级故障2小时响应，市区不超过4小时响应，市区和郊区至少1个工作日响应", labels=labels)]
    assert got == [("一级故障", "", "eq", "120"), ("", "市区", "le", "240"), ("", "?", "ge", "workday:1")]
    assert [q["topic"] for q in quantities.quantities("30天内", "duration")] == ["duration"]


def test_chunks():
    assert [len(c) for c in chunks.packed(["a" * 120, "b" * 450, "c" * 400, "d" * 30])] == [120, 450, 431]
    long = "x" * 300 + "。" + "y" * 300 + "。" + "z" * 600
    assert [len(c) for c in chunks.packed([long])] == [301, 301, 600]
    assert chunks.packed([]) == [] and chunks.packed(["one"]) == ["one"]


@pytest.fixture(scope="module")
def event_stream(spark, sf_dir, tmp_path_factory):
    """`events` as a table, and as a stream of the same rows."""
    folder = str(tmp_path_factory.mktemp("events") / "in")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(folder)
    return events, lambda: spark.readStream.schema(events.schema).parquet(folder)


@pytest.mark.parametrize("name", ["tumbling", "sliding", "sessions", "task_states", "call_meter"])
def test_stream_equals_batch(event_stream, tmp_path, name):
    states = lambda e: e.select(F.col("user_id").alias("task_id"), "ts", "event_id", F.col("event_type").alias("status"), F.col("value").alias("progress"), (F.col("event_type") == "error").alias("cancel"))
    build, mode = {
        "tumbling": (lambda e: windows.tumbling(e, "1 hour", ["event_type"], late="100 days"), "complete"),
        "sliding": (lambda e: windows.sliding(e, "1 hour", "15 minutes", [], late="100 days"), "complete"),
        "sessions": (lambda e: windows.sessions(e, "6 hours", ["user_id"], late="100 days"), "complete"),
        "task_states": (lambda e: windows.task_states(states(e)), "complete"),
        "call_meter": (lambda e: windows.call_meter(streams.token_events(e)), "complete"),
    }[name]
    events, stream = event_stream
    got = windows.run_to_end(build(stream()), f"{name}_test", str(tmp_path / "cp"), mode)
    plain = lambda df: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert plain(got) == plain(build(events)) and got.count() > 0


def test_streams_apply_once_and_join(event_stream, tmp_path):
    events, stream = event_stream
    single = windows.run_to_end(windows.once(stream(), "event_id", late="100 days"), "once_test", str(tmp_path / "cp1"), "append")
    assert sorted(single.select("event_id", "ts").collect()) == sorted(events.select("event_id", "ts").collect())
    pair = lambda e, o: windows.followed(e.filter("event_type = 'click'"), o.filter("event_type = 'purchase'"), "user_id", "2 days", late="100 days")
    got = windows.run_to_end(pair(stream(), stream()), "followed_test", str(tmp_path / "cp2"), "append")
    assert sorted(got.collect()) == sorted(pair(events, events).collect()) and got.count() > 0


def test_event_time_without_a_zone_is_utc(spark):
    """Windows of local times do not move with the session's zone, nor around changes of its clock."""
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00' AS ts, 1.0 AS value UNION ALL SELECT TIMESTAMP_NTZ'2024-10-27 02:30:00.5', 2.0")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert sorted(r.start.isoformat() for r in windows.tumbling(rows, "1 hour", []).collect()) == ["2024-03-31T02:00:00", "2024-10-27T02:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_marks_beyond_the_head(spark, tmp_path):
    said = "x" * 5000 + "【待填写：甲】【工期：待核实】众所周知，大概"
    spark.createDataFrame([(1, said, "web")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    row = plans.QUERIES["marks"](spark, str(tmp_path)).first()
    assert (row.placeholders, row.to_verify, row.cliches) == (4, 2, 2) and "x" * 5000 in row.polished


def test_keywords_are_contained(spark):
    keywords = spark.createDataFrame([("系统架构", False), ("cat", True), ("架构", True), ("没有的词", False)], "keyword string, primary boolean")
    sections = spark.createDataFrame([(1, "系统架构设计", "架构"), (2, "", "cat cat concat"), (3, "其他", None)], "id int, title string, body string")
    assert {r.id: (r.score, r.hits) for r in matching.keyword_hits(keywords, sections, "id").collect()} == {1: (3 + 2 * 4, ["架构", "系统架构"]), 2: (2, ["cat"])}


def test_scan_finds_terms_inside_text(spark):
    clauses = spark.createDataFrame([(1, 1, "★必须 数据备份机制完善"), (1, 2, "▲abc、cde 本项目"), (1, 3, "短语"), (2, 1, "数据备份机制完善")], "grp int, clause_id int, clause string")
    texts = spark.createDataFrame([(1, 10, "我们提供的数据备份机制完善且可靠，另有xabcx与xcdex内容若干字数"), (2, 11, "数据备份机制完善")], "grp int, text_id int, text string")
    got = {(r.grp, r.clause_id): (r.hits, r.covered) for r in checks.keyword_scan(clauses, texts, "clause_id", "grp").collect()}
    assert got == {(1, 1): (1, True), (1, 2): (2, True), (1, 3): (0, False), (2, 1): (0, False)}


@pytest.mark.parametrize(
    ("fact", "said", "relation"),
    [
        ("响应1天", "承诺24小时响应", "backed"), ("响应4小时", "承诺1天响应", "conflict"), ("到达现场1天", "24小时到达现场", "backed"), ("1天内解决", "2天内解决", "conflict"), ("驻场3人", "驻场2人", "conflict"), ("驻场3人", "驻场4人", "stronger"),
        ("1个工作日响应", "1天响应", "incomparable"), ("2个工作日响应", "3个工作日响应", "conflict"), ("2个工作日响应", "1个工作日响应", "stronger"), ("质保1年", "质保12个月", "backed"), ("工期1天", "工期24小时", "backed"), ("响应4小时", "响应2小时", "stronger"),
        ("7×24小时服务", "提供5×8小时服务", "conflict"), ("每月巡检1次", "每周巡检1次", "stronger"), ("一级故障2小时响应", "2小时响应", "scope_unknown"), ("质保1年", "响应2小时", "unbacked"), ("响应不少于4小时", "响应不超过4小时", "conflict"),
    ],
)
def test_commitments_against_facts(spark, fact, said, relation):
    q = lambda text, **more: spark.createDataFrame([(text,)], "text string").select(F.explode(quantities.extracted(F.col("text"))).alias("q")).select("q.*", F.concat_ws("|", "q.severity", "q.scope", "q.subject").alias("place")).select("topic", F.col("place").alias("scope"), "dimension", "number", "value", "approx", "comparator")
    assert [r.relation for r in checks.commitment_relations(q(said), q(fact)).collect()] == [relation]


def test_years_of_experience(spark):
    """Years are no quantity if experience is named right after them, or experience or seniority right before."""
    rows = spark.createDataFrame([(1, "5年从业经验"), (2, "工龄5年"), (3, "质保期5年工龄"), (4, "经验不少于5年"), (5, "质保5年")], "id int, text string")
    found = rows.select("id", F.size(quantities.extracted(F.col("text"))).alias("n")).collect()
    assert {r.id: r.n for r in found} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1}


def test_texts_of_coverage_are_read_once(spark):
    """Texts are searched and counted once, written as sums need them; what is left to do reads no text."""
    nodes = spark.createDataFrame([("c", None, "chapter", "", None), ("a", "c", "A", "工作的流程。很长", 4), ("b", "c", "B", None, 50), ("d", "c", "D", "other text", 10)], "id string, parent_id string, title string, content string, budget long")
    items = spark.createDataFrame([(1, 2.0, "proposal", ["工作流程", "没有的点"]), (2, None, "demo", ["other text"]), (3, 1.0, "demo", ["x"]), (4, 1.0, "demo", ["y"])], "item_id int, points double, kind string, wanted array<string>")
    mapped = spark.createDataFrame([(1, "c"), (2, "d"), (2, "c"), (3, "b")], "item_id int, id string")
    found = coverage.coverage(items, nodes, mapped, trees.closure(nodes))
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.item_id: (r.status, r.coverage, r.missing, r.words, r.budget) for r in found.collect()} == {
        1: ("points missing", 0.5, ["没有的点"], 17, 64), 2: ("covered", 1.0, [], 9, 10), 3: ("not written", 0.0, [], 0, 50), 4: ("not carried", 0.0, [], 0, 0),
    }


def test_core(spark):
    """Fillers that come together once separators go; fillers and separators beside letters and digits."""
    assert one(spark, matching.core(F.col("t")), t="方 案A、b措，施 计-划 7的8 [等]z . \n及（x）对") == "Ab计-划78zx"
