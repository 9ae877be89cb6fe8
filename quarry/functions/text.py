"""Text measurement, clean-up and marks, as column expressions.

Blank characters are given as an explicit class, in a form that both Spark and DuckDB read, for their own classes differ beyond ASCII.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters as Unicode defines them for text.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: The same, one by one.
BLANK_CHARACTERS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Forms that do not count as body text.
CODE_FENCE = r"(?s)```.*?(?:```|\z)"
TABLE_RULE = r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$"
BULLET = r"(?m)^[ \t]*[-+*][ \t]+"
MARKUP = r"[|*#>`]"
DIAGRAM = r"(?s)```mermaid\b.*?(?:```|\z)"
# Bracketed marks for text that is still to be filled in or verified.
PLACEHOLDER = "【[^【】]{0,60}(?:待填写|待核实)[^【】]{0,60}】"
VERIFY_MARK = "【[^【】]{0,60}待核实[^【】]{0,60}】"
# Page numbers and lines of a table of contents.
PAGE_NUMBER = r"^第?[BLANK]*[0-9]+[BLANK]*页([BLANK]*共[BLANK]*[0-9]+[BLANK]*页?)?$|^[0-9]+[BLANK]*/[BLANK]*[0-9]+$".replace("BLANK", BLANKS)
CONTENTS_LINE = r"^.{2,60}[…\.·]{6,}.{0,30}$"
SHORT_LINE, CONTENTS_MOST, REPEATS_KEPT = 40, 90, 3
# Phrases of empty style and weak wording.
CLICHES = (
    "正如(?:前文|上文|我们)?所(?:述|说|知)", "众所周知[，,]?", "毋庸置疑[，,]?", "不可否认的是[，,]?", "值得一提的是[，,]?",
    "在当今(?:快速发展|日新月异|风起云涌|数字化转型)的(?:时代|浪潮中)[，,]?", "总而言之[，,]?|综上所述[，,]?", "宛如|犹如", "不仅如此[，,]?而且",
    "赋能.*?新范式", "作为一家(?:业界领先|卓越|顶尖)的", "在未来的日子里",
)
WEAK_PHRASES = ("我们希望", "大概", "可能", "差不多", "尽量做到", "小伙伴", "老铁", "搞定", "基本上满足")
# Topic words and the tags that they stand for.
TAG_RULES = {
    "架构": ["系统架构", "技术路线"],
    "安全": ["安全方案", "等保", "数据安全"],
    "运维": ["售后服务", "运维保障", "SLA"],
    "实施": ["项目实施", "进度管理", "部署方案"],
    "测试": ["软件测试", "压力测试", "验收标准"],
    "培训": ["人员培训", "交付培训"],
    "信创": ["信创适配", "国产化"],
    "数据库": ["数据库设计", "容灾备份"],
    "微服务": ["微服务", "容器化", "Kubernetes"],
}


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lines(text: Column) -> Column:
    """Lines of a text; null counts as empty, and an empty text is one empty line."""
    return F.split(text_of(text), "\n", -1)


def without_blanks(text: Column) -> Column:
    return F.translate(text, BLANK_CHARACTERS, "")


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARACTERS))


def chars(text: Column) -> Column:
    """Characters that are not blank; null has none."""
    return F.length(without_blanks(text_of(text)))


def body_chars(text: Column) -> Column:
    """Characters of body text: without code fences, table rules, bullets, markup and blanks; null has none."""
    bare = reduce(lambda t, form: F.regexp_replace(t, form, ""), (CODE_FENCE, TABLE_RULE, BULLET, MARKUP), text_of(text))
    return F.length(without_blanks(bare))


def diagram_chars(text: Column) -> Column:
    """Characters inside diagram fences, markers included, that are not blank."""
    return F.length(without_blanks(F.array_join(F.regexp_extract_all(text_of(text), F.lit(DIAGRAM), F.lit(0)), "")))


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text_of(text), F.lit(PLACEHOLDER), F.lit(0))


def cliche_hits(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text_of(text), F.lit(p)) for p in CLICHES])


def weak_phrases(text: Column) -> Column:
    """The weak phrases that occur, in the order of the rule."""
    return F.filter(F.array(*[F.lit(p) for p in WEAK_PHRASES]), lambda p: F.contains(text_of(text), p))


def polished(text: Column) -> Column:
    """Text without empty phrases; other wording is left as it is."""
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), CLICHES, text_of(text))


def tags(breadcrumb: Column, head: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """Sorted distinct tags of the rule words that occur in the breadcrumb or the head of the text."""
    rules = TAG_RULES if rules is None else rules
    none = F.array().cast("array<string>")
    found = [F.when(F.contains(text_of(breadcrumb), F.lit(word)) | F.contains(text_of(head), F.lit(word)), F.array(*[F.lit(t) for t in own])).otherwise(none) for word, own in rules.items()]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def noise_line(line: Column) -> Column:
    """Lines that say nothing by themselves: blank, a page number, a line of a table of contents."""
    text = stripped(line)
    return (text == "") | text.rlike(PAGE_NUMBER) | ((F.length(text) < CONTENTS_MOST) & text.rlike(CONTENTS_LINE))


def page_of(text: Column, offset: int, limit: int) -> Column:
    """A page of a text: start, end, total, truncated and the characters between."""
    whole = text_of(text)
    total = F.length(whole)
    start = F.least(F.greatest(F.lit(offset), F.lit(0)), total)
    end = F.least(start + F.lit(max(limit, 0)), total)
    return F.struct(start.alias("start"), end.alias("end"), total.alias("total"), (end < total).alias("truncated"), F.substring(whole, start + 1, end - start).alias("page"))


def preview(text: Column, most: int = 80) -> Column:
    """The first characters after runs of blanks become one space."""
    return F.substring(stripped(F.regexp_replace(text_of(text), f"[{BLANKS}]+", " ")), 1, most)


def context_text(name: Column, breadcrumb: Column, content: Column) -> Column:
    """What a chunk is indexed by: its document's name, its place and its text."""
    place = F.when(text_of(breadcrumb) != "", F.concat(F.lit(" "), breadcrumb)).otherwise("")
    return F.concat(F.lit("《"), text_of(name), F.lit("》"), place, F.lit("\n"), text_of(content))


def compose(summary: Column, content: Column, most: int = 180) -> Column:
    """A chunk with the head of its parent's summary in front, unless it holds that already."""
    head = F.substring(text_of(summary), 1, most)
    return F.when((head == "") | F.contains(text_of(content), head), text_of(content)).otherwise(F.concat(head, F.lit("\n"), text_of(content)))


def plain_html(html: Column) -> Column:
    """Text of a page: without scripts, styles and tags, runs of blanks as one space."""
    bare = F.regexp_replace(text_of(html), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    return stripped(F.regexp_replace(bare, f"[{BLANKS}]+", " "))
