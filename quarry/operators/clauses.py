"""Clauses of a tender: marked lines and their levels, requirements, labelled values and segments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, stripped, text_of, without_blanks

# Marks of clauses, words that say what a mark means, and words of requirements.
MARKERS = "★※▲◆☆△#"
DISQUALIFIES = "无效投标|无效响应|投标无效|废标|否决|实质性|投标被拒绝|拒绝其投标|不通过符合性审查"
DEDUCTS = "评标因素|评分|扣分|扣除|酌情|重要"
DENIED = "不(?:作为|属于|视为|构成|按)[^，。；;]{0,12}(?:无效|废标|实质|否决)[^，。；;]*"
QUOTES = ("[“\"「‘'（(]?\\s*", "\\s*[”\"」’'）)]?")
LEGEND = (
    f"(?:(?:标有|标注有|带有|打有|凡标)\\s*{QUOTES[0]}|标\\s*[“\"「‘'（(]\\s*)([{MARKERS}]){QUOTES[1]}"
    f"|{QUOTES[0]}([{MARKERS}]){QUOTES[1]}\\s*(?:号|符号)?\\s*的?\\s*(?:标注|标识|标记|代表|表示)"
)
USUAL = {"★": "redline", "▲": "important"}
LEVELS = ("redline", "important", "normal")
LINE_WORDS = "必须|应当|支持|具备|提供|采用|配置|实现|符合"
SHOULD = "应(?:[^用急答对收付标]|$)"
ASKS = SHOULD + "|须|必须|要求|支持|具备|提供|实现|满足|不少于|不低于|不超过|不高于|≥|≤|确保|负责|完成|具有|包括|包含"
INSISTS = SHOULD + "|须|必须|支持|具备|提供|实现|满足|不少于|不低于|不超过|不高于|≥|≤|确保"
TOTALS = "^(?:合计|总计|小计|总价)"
SCORING_HEAD, REQUIREMENT_HEAD = "分值|评分|得分", "需求|要求|内容|标准|参数|指标|功能|规格"
AMOUNT = rf"^[0-9.,，%％元万台套个项人天年月日/{BLANKS}\-—]*$"
NOT_MENTIONED = "未提及"
MOST_REDLINES, MOST_IMPORTANT, MOST_REQUIREMENTS, SEGMENT_CHARS = 40, 60, 60, 12_000


def meanings(text: str | None) -> dict[str, str]:
    """What each mark means by the sentences of a text that define it; where none does, the usual marks have their usual meaning."""
    found: dict[str, str] = {}
    for line in (text or "").split("\n"):
        places = list(re.finditer(LEGEND, line))
        for m, end in zip(places, [*(p.start() for p in places[1:]), len(line)], strict=False):
            said = re.sub(DENIED, "", line[m.start() : end])
            level = "redline" if re.search(DISQUALIFIES, said) else "important" if re.search(DEDUCTS, said) else None
            if level:
                found.setdefault(m[1] or m[2], level)
    return USUAL | found


def marker_levels(text: Column) -> Column:
    """A map from marks to levels for each text (see `meanings`)."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([meanings(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "map<string,string>")(text)


def usual_levels() -> Column:
    return F.create_map(*[F.lit(x) for pair in USUAL.items() for x in pair])


def is_reference(line: Column) -> Column:
    """Lines that explain or quote marks; they are no clauses themselves."""
    return F.contains(line, F.lit("标注")) | line.rlike(LEGEND)


def level_of(line: Column, levels: Column) -> Column:
    """The gravest level of the marks in a line, null without any."""
    own = F.transform(F.filter(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(line, m)), lambda m: F.element_at(levels, m))
    return F.when(F.array_contains(own, "redline"), "redline").when(F.array_contains(own, "important"), "important")


def level_order(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)


def fingerprint(text: Column) -> Column:
    return F.substring(F.md5(without_blanks(text)), 1, 16)


def marked_clauses(lines: DataFrame) -> DataFrame:
    """doc_id, level, number, clause: the marked lines of each document, at most 40 of the gravest level and 60 of the other.

    lines: doc_id, pos, line, levels (what marks mean in the document).
    """
    own = lines.withColumn("clause", stripped(text_of(F.col("line"))))
    own = own.filter((F.length("clause") > 4) & (F.length("clause") < 200) & ~is_reference(F.col("clause"))).withColumn("level", level_of(F.col("clause"), F.col("levels"))).filter("level IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("doc_id", "level").orderBy("pos"))
    most = F.when(F.col("level") == "redline", MOST_REDLINES).otherwise(MOST_IMPORTANT)
    return own.withColumn("number", number).filter(F.col("number") <= most).select("doc_id", "level", "number", "clause")


def requirements(lines: DataFrame, most: int = MOST_REQUIREMENTS) -> DataFrame:
    """doc_id, index, level, clause, fingerprint: lines that are marked or ask for something; the first `most` distinct ones of a
    document, numbered by level, then place."""
    own = lines.withColumn("line", stripped(text_of(F.col("line")))).filter((F.col("line") != "") & ~is_reference(F.col("line"))).withColumn("level", level_of(F.col("line"), F.col("levels")))
    own = own.filter(F.col("level").isNotNull() | (F.col("line").rlike(LINE_WORDS) & F.length("line").between(6, 300)))
    own = own.withColumn("clause", F.regexp_replace("line", r"^[0-9]+[、.．\s]+", "")).withColumn("fingerprint", fingerprint(F.col("clause")))
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "fingerprint").orderBy("pos"))).filter("_r = 1")
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).filter(F.col("_r") <= most).withColumn("level", F.coalesce("level", F.lit("normal")))
    return renumbered(first, ["doc_id"], [level_order(F.col("level")), F.col("pos")]).select("doc_id", "index", "level", "clause", "fingerprint")


def renumbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with index: their number in an order, from 1."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def clause_coverage(clauses: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, extracted, redlines, important, marked (lines of the gravest level) and uncovered, for every document with lines."""
    marked = lines.groupBy("doc_id").agg(F.count_if((stripped(text_of(F.col("line"))) != "") & ~is_reference(text_of(F.col("line"))) & (level_of(text_of(F.col("line")), F.col("levels")) == "redline")).alias("marked"))
    own = clauses.groupBy("doc_id").agg(F.count("*").alias("extracted"), F.count_if(F.col("level") == "redline").alias("redlines"), F.count_if(F.col("level") == "important").alias("important"))
    rows = marked.join(own, "doc_id", "left").fillna(0, ["extracted", "redlines", "important"])
    return rows.withColumn("uncovered", F.greatest(F.lit(0), F.col("marked") - F.col("redlines")))


def is_label(line: Column) -> Column:
    """A short line that heads others: it insists on nothing and does not end like a sentence."""
    t = stripped(text_of(line))
    return F.length(t).between(1, 29) & ~t.rlike(INSISTS) & ~t.rlike("[。；;！!？?：:，,]$")


def is_requirement(line: Column, levels: Column) -> Column:
    t = stripped(text_of(line))
    return (F.length(t) >= 8) & ~is_reference(t) & ~t.rlike(TOTALS) & (level_of(t, levels).isNotNull() | t.rlike(ASKS))


def requirement_rows(grid: Column) -> Column:
    """The rows of a table of requirements as texts "cell：cell": without numbers, amounts and repeated cells; none of a scoring table."""
    head = F.array_join(F.get(grid, F.lit(0)), " ")
    cells = lambda row: F.filter(F.transform(row, lambda c: stripped(text_of(c))), lambda c: c != "")
    bare = lambda row: F.array_distinct(F.filter(F.filter(cells(row), lambda c, i: ~((i == 0) & c.rlike("^[0-9]{1,3}$"))), lambda c: ~c.rlike(AMOUNT)))
    rows = F.transform(F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0))), lambda r: F.array_join(bare(r), "："))
    fits = (F.size(grid) >= 2) & ~head.rlike(SCORING_HEAD) & head.rlike(REQUIREMENT_HEAD)
    return F.when(fits, F.filter(rows, lambda t: (F.length(t) >= 8) & ~t.rlike(TOTALS))).otherwise(F.array().cast("array<string>"))


def labelled(text: Column, labels: str, until: str = "，。；", next_field: str | None = None) -> Column:
    """The first good value after one of the labels ("a|b") and a colon: no piece of a table, no label without a value; cut at the next field."""
    found = F.regexp_extract_all(text_of(text), F.lit(rf"(?:{labels})[:：\s]+([^\n\r{until}]+)"), F.lit(1))
    cut = F.transform(found, lambda v: stripped(F.element_at(F.split(stripped(v), rf"\s*(?:{next_field})\s*[:：]", 2), 1) if next_field else stripped(v)))
    return F.coalesce(F.get(F.filter(cut, lambda v: ~F.contains(v, F.lit("|")) & (F.length(v) >= 2) & ~v.rlike("[：:]$|^[（(][^）)]*[）)]$")), F.lit(0)), F.lit(""))


def merged_values(rows: DataFrame) -> DataFrame:
    """doc_id, field, value: of each field the first value by seq that says something."""
    good = rows.filter((stripped(text_of(F.col("value"))) != "") & (stripped(F.col("value")) != NOT_MENTIONED))
    return good.groupBy("doc_id", "field").agg(F.min_by("value", "seq").alias("value"))


def merged_lists(rows: DataFrame, most: int = 80) -> DataFrame:
    """doc_id, field, items: the items of all lists in their order, those that agree in their first characters once."""
    each = rows.select("doc_id", "field", "seq", F.posexplode("items").alias("place", "item")).withColumn("key", F.substring(without_blanks(text_of(F.col("item"))), 1, most)).filter("key != ''")
    first = each.groupBy("doc_id", "field", "key").agg(F.min(F.struct("seq", "place", "item")).alias("first"))
    return first.groupBy("doc_id", "field").agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["item"]).alias("items"))


def cut_segments(text: str | None, most: int = SEGMENT_CHARS) -> list[str]:
    """Whole lines put together up to `most` characters; a longer line is a segment of its own."""
    out: list[list[str]] = [[]]
    size = 0
    for line in (text or "").split("\n"):
        if out[-1] and size + len(line) > most:
            out.append([])
            size = 0
        out[-1].append(line)
        size += len(line) + 1
    return ["\n".join(lines) for lines in out]


def segments(text: Column, most: int = SEGMENT_CHARS) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_segments(t, most) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<string>")(text)


def loose_json(raw: Column) -> Column:
    """The JSON object in an answer: the answer itself, without a code fence, or what stands between its outermost braces; null if none."""
    bare = F.regexp_replace(F.regexp_replace(stripped(text_of(raw)), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    valid = lambda t: F.try_parse_json(t).isNotNull() & t.rlike(r"(?s)^\s*\{")
    return F.when(valid(bare), bare).when((inner != "") & valid(inner), inner)
