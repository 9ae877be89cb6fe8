"""Rubrics and packages: labels of packages, kinds of scoring items, scoring tables, and clauses by the package that they belong to."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cell_text, points_cell
from ..functions.text import stripped, text_of
from .clauses import fingerprint, is_label, is_requirement, level_of, level_order, renumbered, requirement_rows
from .matching import let

# Numerals of packages, how packages are named, what may stand before a label and after it.
NUMERALS = "一二三四五六七八九十"
PACKAGE = rf"第\s*(?:[{NUMERALS}0-9]{{1,2}})\s*(?:分包|包)|(?:分包|包)\s*(?:[{NUMERALS}0-9]{{1,2}}|[A-Za-z](?![A-Za-z]))|(?<![A-Za-z])[A-Za-z]\s*(?:分包|包)"
LABEL = rf"^(?:[（(][{NUMERALS}0-9]{{1,3}}[)）]|[{NUMERALS}0-9]{{1,3}}[、.．)）])?\s*(?:{PACKAGE})(?:$|[：:（( 　、，,\-—])"
LABEL_CHARS = 60
# Kinds of items by category and name, kinds of answers, and names by words of the criteria.
PRICE, BUSINESS, TECHNICAL, PROVEN = "报价|价格", "商务|资信|信誉", "技术|服务|质量|方案", "业绩|资质|人员|团队|证书"
COMPLIANCE, EVIDENCE = "偏离|响应程度|基础服务", "证书|业绩|案例|职称|人员|资质|认证|著作权|团队|经验"
PROPOSAL = "方案|认识|理解|分析|保障|制度|计划|措施|规划|设计"
NAMES = {
    "投标报价|评标基准价|价格分": "投标报价", "项目负责人|项目经理": "项目负责人资质", "技术负责人": "技术负责人资质", "其他成员|团队成员|项目团队|拟派.*人员": "团队人员配置", "业绩|案例": "类似项目业绩",
    "体系认证|认证证书|资质证书": "企业资质认证", "著作权": "软件著作权",
}
# Heads of scoring tables, rows of totals, and sections with and without requirements.
HEAD_POINTS, HEAD_CRITERIA, HEAD_WEAK = "^(?:分值|分数|满分|标准分|权重分值)", "评分标准|评审标准|评标标准|评分细则|评审细则|评分办法|评分说明|评分要求|具体要求", "评分内容|评审内容"
HEAD_FACTOR, HEAD_NONE = "评分因素|评审因素|评分项|评审项|评分类别|评审类别|评分内容|评审内容|项目|类别", "扣分标准|考核"
TOTAL = "^(?:合计|总计|总分|小计)"
WANTED_PART, OTHER_PART, BACKGROUND = "需求|要求", "商务|须知|评标|评审|评分|合同|格式|邀请|资格|报价", "概况|背景|简介|介绍|现状|一览表"


def package_name(said: Column) -> Column:
    """One way to write a package: its number in digits after 包, or its letter in upper case before it."""
    core = F.regexp_replace(said, r"[第分包\s]", "")
    place = F.array_position(F.array(*[F.lit(c) for c in NUMERALS]), core)
    return F.when(core.rlike("^[A-Za-z]$"), F.concat(F.upper(core), F.lit("包"))).otherwise(F.concat(F.lit("包"), F.when(place > 0, place.cast("string")).otherwise(core)))


def package_labels(text: Column) -> Column:
    """The packages that a text names, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(text), F.lit(PACKAGE), F.lit(0)), package_name))


def package_marker(text: Column) -> Column:
    """The package of a short line that is a label of one; empty for a label of several, null for other lines."""
    t = stripped(text_of(text))
    label = F.length(t).between(1, LABEL_CHARS) & ~t.rlike("[。；;]") & t.rlike(LABEL)
    own = package_labels(t)
    return F.when(label, F.when(F.size(own) == 1, F.get(own, F.lit(0))).otherwise(""))


def item_kind(category: Column, name: Column) -> Column:
    both = F.concat(text_of(category), text_of(name))
    return F.when(both.rlike(PRICE), "price").when(text_of(category).rlike(BUSINESS), "business").when(text_of(category).rlike(TECHNICAL), "technical").when(text_of(name).rlike(PROVEN), "business").otherwise("other")


def answer_kind(kind: Column, name: Column, criteria: Column) -> Column:
    """How an item is answered: price, demo, compliance, evidence or proposal."""
    n, c = text_of(name), text_of(criteria)
    return (
        F.when(kind == "price", "price").when(F.contains(n, F.lit("演示")) | F.contains(F.substring(c, 1, 60), F.lit("演示")), "demo").when(n.rlike(COMPLIANCE) | (F.contains(c, F.lit("起评分")) & F.contains(c, F.lit("扣"))), "compliance")
        .when(n.rlike(EVIDENCE) & ~F.contains(n, F.lit("方案")), "evidence").when(n.rlike(PROPOSAL), "proposal").when(F.substring(c, 1, 80).rlike(f"{EVIDENCE}|能力|配置"), "evidence").otherwise("proposal")
    )


def name_from_criteria(criteria: Column) -> Column:
    """A short first phrase of the criteria that is no date, else a name by their words, else empty."""
    bare = F.regexp_replace(stripped(text_of(criteria)), r"^(?:[0-9]{1,2}\s*[.、．]|[（(][0-9]{1,2}[）)])\s*", "")
    first = F.element_at(F.split(bare, r"[\s，,。；;：:（(]", 2), 1)
    out = F.when(F.length(first).between(2, 12) & ~first.rlike("^(?:19|20)[0-9]{2}"), first)
    for words, name in NAMES.items():
        out = out.when(F.substring(text_of(criteria), 1, 120).rlike(words), name)
    return out.otherwise("")


def head_columns(cells: Column) -> Column:
    """Places (from 0) of points, criteria, category and name in the head of a scoring table, and its width; null where it is none."""
    all_of = F.sequence(F.lit(0), F.size(cells) - 1)
    first = lambda fits: F.get(F.filter(all_of, fits), F.lit(0))
    other = lambda j, *known: reduce(lambda rest, k: rest & ~F.coalesce(k == j, F.lit(False)), known, F.lit(True))

    def with_factors(points: Column, criteria: Column) -> Column:
        def found(factors: Column) -> Column:
            none = (F.size(cells) < 1) | F.array_join(cells, "").rlike(HEAD_NONE) | criteria.isNull() | (points.isNull() & (F.size(factors) == 0))
            return F.when(~none, F.struct(points.alias("points"), criteria.alias("criteria"), F.get(factors, F.lit(0)).alias("category"), F.get(factors, F.lit(1)).alias("name"), F.size(cells).alias("width")))

        return let(F.filter(all_of, lambda j: other(j, points, criteria) & F.get(cells, j).rlike(HEAD_FACTOR)), found)

    def with_criteria(points: Column) -> Column:
        criteria = F.coalesce(first(lambda j: F.get(cells, j).rlike(HEAD_CRITERIA) & other(j, points)), first(lambda j: F.get(cells, j).rlike(HEAD_WEAK) & other(j, points)))
        return let(criteria, lambda c: with_factors(points, c))

    return let(first(lambda j: F.get(cells, j).rlike(HEAD_POINTS)), with_criteria)


def rubric_items(tables: DataFrame) -> DataFrame:
    """table_id, number, package, category, name, points, kind, answer, criteria of the items of scoring tables.

    tables: table_id, rows (array of rows of cells), keys (numbers of the physical cells, equal where cells are merged
    downwards), context (what stands before). The head is one of the first three rows. A row whose cell of points is merged with
    that of the row before goes on with its item; one whose name is merged with it but not its points adds its points. Rows
    of totals and of other widths are left out, and end an item. A table that repeats another is taken once.
    """
    clean = lambda r: F.transform(r, cell_text)
    heads = F.transform(F.slice("rows", 1, 3), lambda r, i: F.struct(i.alias("at"), let(clean(r), head_columns).alias("columns")))
    own = tables.withColumn("_same", F.row_number().over(Window.partitionBy(F.xxhash64("rows")).orderBy("table_id"))).filter("_same = 1")
    own = own.withColumn("head", F.get(F.filter(heads, lambda h: h["columns"].isNotNull()), F.lit(0))).filter("head IS NOT NULL")
    named = F.get(F.reverse(package_labels(F.col("context"))), F.lit(0))
    rows = own.select("table_id", F.coalesce(named, F.lit("")).alias("package"), "head", "keys", F.posexplode("rows").alias("at", "row")).filter(F.col("at") > F.col("head.at"))
    cell = lambda c: F.coalesce(F.get("row", F.col(f"head.columns.{c}")), F.lit(""))
    merged = lambda c: F.get(F.get("keys", F.col("at")), F.col(f"head.columns.{c}"))
    rows = rows.select(
        "table_id", "package", "at", (F.size("row") == F.col("head.columns.width")).alias("fits"), cell("category").alias("category"), cell_text(cell("name")).alias("name"), cell("points").alias("cell"), stripped(cell("criteria")).alias("criteria"),
        F.col("head.columns.points").isNotNull().alias("pointed"), F.coalesce(merged("points"), merged("name"), merged("category")).alias("points_key"), F.when(F.col("head.columns.points").isNotNull(), merged("name")).alias("name_key"),
    )
    rows = rows.withColumn("ok", F.col("fits") & ~cell_text(F.concat("category", "name", "cell")).rlike(TOTAL) & ((F.col("cell") != "") | (F.col("criteria") != "")))
    along = Window.partitionBy("table_id").orderBy("at")
    went_on = F.lag("ok").over(along)
    same_points = F.coalesce(went_on & (F.lag("points_key").over(along) == F.col("points_key")), F.lit(False))
    same_name = F.coalesce(went_on & (F.lag("name_key").over(along) == F.col("name_key")), F.lit(False))
    rows = rows.withColumn("adds", ~same_points).withColumn("new", (F.col("ok") & ~same_points & ~same_name).cast("int")).withColumn("item", F.sum("new").over(along)).filter("ok")
    whole = F.when(F.col("pointed"), points_cell(F.col("cell"))).otherwise(points_cell(F.when(F.col("name") != "", F.col("name")).otherwise(F.col("category"))))
    rows = rows.withColumn("p", whole)
    first = F.min_by(F.struct("package", "category", F.when(F.col("pointed") & (F.col("name") != ""), F.col("name")).otherwise(F.col("p.name")).alias("name")), "at").alias("first")
    said = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("criteria") != "", F.struct("at", "criteria")))), lambda x: x["criteria"])).alias("said")  # the rows of one item
    items = rows.groupBy("table_id", "item").agg(first, F.sum(F.when(F.col("adds"), F.col("p.points"))).alias("points"), said)
    items = items.select("table_id", F.col("item").cast("int").alias("number"), "first.package", "first.category", F.col("first.name").alias("_name"), "points", F.array_join("said", "\n").alias("criteria"))
    price = points_cell(F.col("category"))["name"]
    name = F.when(F.col("_name") != "", F.col("_name")).when(item_kind(F.col("category"), F.lit("")) == "price", price).otherwise(name_from_criteria(F.col("criteria")))
    items = items.withColumn("name", F.when(name != "", name).otherwise(F.concat("category", F.lit("#"), "number"))).withColumn("kind", item_kind(F.col("category"), F.col("name")))
    return items.select("table_id", "number", "package", "category", "name", "points", "kind", answer_kind(F.col("kind"), F.col("name"), F.col("criteria")).alias("answer"), "criteria")


SCOPED = "array<struct<place:int,section:string,level:string,package:string,clause:string>>"


class Scope:
    """Which package holds at a place of a section tree: that of the last label, else of the innermost title that names one.

    A title's package holds in its section, a label's until the next label or the end of its section; a label at the very
    end of a section leads those that follow, and holds until the section above ends. "" is what all packages share.
    """

    def __init__(self):
        self.titles: list[tuple[int, str, tuple[int, str] | None]] = []
        self.label: tuple[int, str] | None = None

    def enter(self, depth: int, named: list[str]) -> None:
        while self.titles and self.titles[-1][0] >= depth:
            self.label = self.titles.pop()[2]
        if self.label and self.label[0] >= depth:
            self.label = None
        if named:
            self.titles.append((depth, named[0] if len(named) == 1 else "", self.label))
            self.label = None

    def mark(self, depth: int, package: str, leads: bool) -> None:
        self.label = (depth - leads, package)

    @property
    def package(self) -> str:
        return self.label[1] if self.label else self.titles[-1][1] if self.titles else ""


def scoped(events: list) -> list[dict]:
    """Clauses of a document from its events in order: titles, paragraphs and rows of tables with what was told of each."""
    out, scope, path, heading, wanted, held, skip = [], Scope(), [], None, False, None, False

    def add(e, text: str, level: str | None, package: str | None = None) -> None:
        out.append({"place": len(out), "section": " > ".join(path), "level": level or heading or "normal", "package": scope.package if package is None else package, "clause": text})

    def drop_label() -> None:
        nonlocal held
        if held and held["level"] and not held["used"]:
            add(held["event"], held["text"], held["level"])
        held = None

    for n, e in enumerate(events):
        if e["kind"] == "title":
            drop_label()
            if e["depth"] == 0:
                wanted, scope = e["wanted"], Scope()
            path = path[: e["depth"]] + [e["text"]]
            heading, skip = e["level"], e["background"] and not e["level"]
            if wanted:
                scope.enter(e["depth"], list(e["packages"]))
        elif not wanted:
            continue
        elif e["kind"] == "row":
            if not skip:
                add(e, e["text"], e["level"], e["marker"])
        elif e["marker"] is not None:
            if not skip:
                drop_label()
            held = None
            following = events[n + 1] if n + 1 < len(events) else None
            leads = following is None or following["kind"] == "title" and following["depth"] <= e["depth"]
            scope.mark(e["depth"], e["marker"], leads)
        elif skip:
            continue
        elif e["label"]:
            drop_label()
            held = {"text": e["text"], "level": e["level"], "used": False, "event": e}
        elif e["asks"]:
            if held and held["level"]:
                add(e, f"{held['text']}：{e['text']}", e["level"] or held["level"])
                held["used"] = True
            else:
                add(e, e["text"], e["level"])
    drop_label()
    return out


def scoped_clauses(blocks: DataFrame) -> DataFrame:
    """doc_id, index, level, package, section (path), clause, fingerprint: the clauses of the parts with requirements, by level, then place.

    blocks: doc_id, pos, depth, kind (title, para or table), text, grid (rows of a table's cells), levels (what marks mean), in
    the order of the document. What a block says of itself is told by columns; one pass over a document carries scopes and
    labels on. Clauses that repeat in a section, level and package are taken once.
    """
    rows = F.when(F.col("kind") == "table", F.transform(requirement_rows(F.col("grid")), lambda t: F.struct(F.lit("row").alias("kind"), t.alias("text")))).otherwise(F.array(F.struct("kind", stripped(text_of(F.col("text"))).alias("text"))))
    each = blocks.select("doc_id", "pos", "depth", "levels", F.posexplode(rows).alias("n", "b")).select("doc_id", "pos", "n", "depth", "levels", "b.kind", "b.text").filter("text != ''")
    title = F.col("text")
    head = F.element_at(F.split("text", "：", 2), 1)
    each = each.select(
        "doc_id", "pos", "n", F.col("depth").cast("int").alias("depth"), "kind", "text", level_of(F.col("text"), F.col("levels")).alias("level"),
        package_labels(title).alias("packages"), F.when(F.col("kind") == "row", package_marker(head)).otherwise(package_marker(title)).alias("marker"), is_label(title).alias("label"), is_requirement(title, F.col("levels")).alias("asks"),
        (title.rlike(WANTED_PART) & ~title.rlike(OTHER_PART)).alias("wanted"), title.rlike(BACKGROUND).alias("background"),
    )
    one = F.array_sort(F.collect_list(F.struct("pos", "n", *[c for c in each.columns if c not in ("doc_id", "pos", "n")]))).alias("events")  # the blocks of one document

    @F.pandas_udf(SCOPED)
    def fold(events: pd.Series) -> pd.Series:
        return pd.Series([scoped(list(e)) for e in events], dtype=object)

    found = each.groupBy("doc_id").agg(one).select("doc_id", F.explode(fold("events")).alias("c")).select("doc_id", "c.*").withColumn("fingerprint", fingerprint(F.col("clause")))
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "package", "section", "level", "fingerprint").orderBy("place"))).filter("_r = 1")
    return renumbered(first, ["doc_id"], [level_order(F.col("level")), F.col("place")]).select("doc_id", "index", "level", "package", "section", "clause", "fingerprint")


def of_package(clauses: DataFrame, target: str) -> DataFrame:
    """Clauses of a package and those that all share; all clauses of documents that do not name it."""
    named = clauses.filter(F.col("package") == target).select("doc_id").distinct().withColumn("_named", F.lit(True))
    return clauses.join(named, "doc_id", "left").filter(F.col("_named").isNull() | F.col("package").isin(target, "")).drop("_named")
