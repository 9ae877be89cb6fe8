"""Paragraphs from lines of pages: measures of each document and page, and which line goes on with the paragraph of the one before.

Whether a line goes on depends on the lines before it and on one bit: whether the line before went on itself. Both answers are
found for every line at once; a line whose answers agree fixes the bit, one whose answers are turned round flips it, and the
bit of each line is that of the last fixed line, flipped as often as lines since then ask for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped, text_of
from .matching import let
from .trees import cut

# Ends of clauses, beginnings of numbered paragraphs, dots that lead to a page number.
CLAUSE_ENDS = "[。；;！!？?：:]$"
PARAGRAPH_START = (
    r"^(?:[★※▲◆●■□√]|第[一二三四五六七八九十百\d]+[篇章节条部]|[一二三四五六七八九十]+[、.．]"
    r"|[（(][一二三四五六七八九十\d]{1,3}[）)]|\d{1,2}(?:[.．]\d{1,2})*[、.．)）](?!\d)|[①-⑳]"
    r"|\d{1,2}(?:[.．]\d{1,2})+(?=\s*[^\s\d.．万元亿%％倍个]))"
)
LEADER = r"[.…·．]{4,}\s*[-—]?\s*\d{1,4}\s*[-—]?\s*$"
LATIN_END, LATIN_START = r"[A-Za-z0-9,.;:)\]]$", r"^[A-Za-z0-9(\[]"
IDEOGRAPHS, MARKS = r"\x{3400}-\x{9fff}\x{f900}-\x{faff}", r"\x{3000}-\x{303f}\x{ff01}-\x{ff60}\x{2018}-\x{201f}\x{2026}\x{b7}"
#: Gaps of a page count from so many on; a document without lines has this size.
LEAST_GAPS, USUAL_SIZE = 5, 10.5


def cleaned(text: Column) -> Column:
    """A line or cell without the blanks that typesetting puts between ideographs and Latin, and between ideographs set apart one by one."""
    # What stands before a blank is looked at where a blank is, not at every character.
    even = F.regexp_replace(F.replace(text_of(text), F.lit("\u3000"), F.lit(" ")), rf"(?=[ \xa0])(?:(?<=[{IDEOGRAPHS}{MARKS}])[ \xa0]+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9%])[ \xa0]+(?=[{IDEOGRAPHS}{MARKS}]))", "")
    together = F.regexp_replace(even, rf"(?=[ \xa0])(?<=(?<![{IDEOGRAPHS}])[{IDEOGRAPHS}])[ \xa0]+(?=[{IDEOGRAPHS}](?![{IDEOGRAPHS}]))", "")
    return stripped(F.regexp_replace(together, r"[ \xa0\t]{2,}", " "))


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the size that most characters (chars, by line) have; of equal ones that which comes first."""
    each = lines.groupBy("doc_id", "size").agg(F.sum("chars").alias("n"), F.min(F.struct("page", "pos")).alias("first"))
    best = each.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")))
    return best.filter("_k = 1").select("doc_id", F.col("size").alias("body"))


def commonest(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, samples): the value met most, of equal ones that which comes first, and how many values there are."""
    each = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    own = Window.partitionBy(*keys)
    best = each.withColumn("samples", F.sum("n").over(own)).withColumn("_k", F.row_number().over(own.orderBy(F.desc("n"), "first")))
    return best.filter("_k = 1").select(*keys, value, "samples")


def right_edge(ends: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, edge, n): the rightmost end of a line at which, within one character's width to its left, `share` of all ends (three at least) lie; and all ends."""
    own = Window.partitionBy(*keys)
    # In millionths of a character's width, so that a range of whole numbers is one width.
    near = own.orderBy(F.round(F.col("x1") / F.col("body") * 1_000_000).cast("long")).rangeBetween(-1_000_000, Window.currentRow)
    rows = ends.withColumn("_n", F.count("*").over(own)).withColumn("_here", F.count("*").over(near))
    fit = F.when(F.col("_here") >= F.greatest(F.lit(3.0), F.col("_n") * share), F.col("x1"))
    return rows.groupBy(*keys).agg(F.max(fit).alias("edge"), F.count("*").alias("n"), F.max("x1").alias("last"))


def page_measures(lines: DataFrame) -> DataFrame:
    """(doc_id, page, body, gap, margin, right): size of body text, usual gap between lines, left margin and right edge of each page.

    lines: doc_id, page, pos, x0, y0, x1, y1, size, bold, text, width, height, in_table. Only lines of body size outside
    tables count. Margin and edge are those of all pages of the same size; a page with six long lines or more has an edge of
    its own, unless that lies far to the left. A gap is that of the page, or with few samples of the document.
    Of texts only their lengths are needed: lines are cut out of their documents once and written without texts.
    """
    lines = cut(lines.select("doc_id", "page", "pos", "x0", "y0", "x1", "y1", "size", F.length("text").alias("chars"), "width", "height", "in_table"), "lines")
    pages = lines.groupBy("doc_id", "page").agg(F.bround(F.first("width")).alias("w"), F.bround(F.first("height")).alias("h"), F.first("width").alias("width"))
    rows = lines.join(body_size(lines), "doc_id").join(pages.select("doc_id", "page", "w", "h"), ["doc_id", "page"])
    own = rows.filter((F.abs(F.col("size") - F.col("body")) <= 1) & ~F.col("in_table"))
    along = Window.partitionBy("doc_id", "page").orderBy("pos")
    space = F.col("y0") - F.lag("y1").over(along)
    gaps = own.withColumn("_gap", F.when((space >= 0) & (space <= 3 * F.col("body")) & (F.col("x0") < F.lag("x1").over(along)), F.bround(space))).filter("_gap IS NOT NULL").withColumn("_at", F.struct("page", "pos"))
    page_gap = commonest(gaps, ["doc_id", "page"], "_gap", "_at").filter(F.col("samples") >= LEAST_GAPS).select("doc_id", "page", F.col("_gap").alias("page_gap"))
    doc_gap = commonest(gaps, ["doc_id"], "_gap", "_at").select("doc_id", F.col("_gap").alias("doc_gap"))
    kind = ["doc_id", "w", "h"]
    lefts = own.groupBy(*kind, F.bround("x0").alias("x")).agg(F.count("*").alias("n")).withColumn("_all", F.sum("n").over(Window.partitionBy(*kind)))
    margins = lefts.groupBy(*kind).agg(F.coalesce(F.min(F.when(F.col("n") >= F.greatest(F.lit(3.0), F.col("_all") * 0.05), F.col("x"))), F.min("x")).alias("margin"))
    long = own.filter((F.col("chars") >= 10) & (F.col("x1") > F.col("w") / 2))
    rights = right_edge(long, kind, 0.2).select(*kind, F.coalesce("edge", "last").alias("right"))
    long_here = own.filter((F.col("chars") >= 10) & (F.col("x1") > F.col("width") / 2))
    here = right_edge(long_here, ["doc_id", "page"], 0.25).filter("n >= 6").select("doc_id", "page", F.col("edge").alias("own_edge"))
    out = pages.join(body_size(lines), "doc_id").join(page_gap, ["doc_id", "page"], "left").join(doc_gap, "doc_id", "left").join(margins, kind, "left").join(rights, kind, "left").join(here, ["doc_id", "page"], "left")
    right = F.coalesce("right", "w")
    return out.select("doc_id", "page", "body", F.coalesce("page_gap", "doc_gap", F.lit(0.0)).alias("gap"), F.coalesce("margin", F.lit(0.0)).alias("margin"), F.when(F.col("own_edge") >= right - 3 * F.col("body"), F.col("own_edge")).otherwise(right).alias("right"))


def looks(text: Column) -> Column:
    """What a line's text says of paragraphs: whether it begins one, ends a clause (by its last character), and leads to a page number."""
    said = stripped(text_of(text))
    return F.struct(said.rlike(PARAGRAPH_START).alias("begins"), F.substring(said, -1, 1).rlike(CLAUSE_ENDS).alias("ends"), text.rlike(LEADER).alias("leads"))


def goes_on(first: bool, own: Column | None = None, last: Column | None = None) -> Column:
    """Whether a line goes on with the paragraph of the line before it, given whether that one is its paragraph's first.

    Columns: the line's own, those of the line before with _p, and x1 of the line before that with _b. own and last: `looks`
    of the line and of the one before, where they are known already.
    """
    own, last = looks(F.col("text")) if own is None else own, looks(F.col("_p.text")) if last is None else last
    size, right = F.greatest("_p.size", "size", F.lit(1.0)), F.col("_p.right")
    mid = ~last["ends"]
    begins, bold, was_bold = own["begins"], F.col("bold"), F.col("_p.bold")
    x1, near = F.col("_p.x1"), F.col("page").isin(F.col("_p.page"), F.col("_p.page") + 1)
    to_edge = x1 >= right - 4 * size
    ragged = F.when(mid & near, to_edge | (F.lit(first) & (F.col("x0") < F.col("_p.x0") - 0.8 * size))).otherwise(F.lit(not first) & to_edge & (F.abs(x1 - F.col("_b.x1")) <= 0.5 * size))
    full = (x1 >= right - 1.5 * size) | ((x1 >= right - 5 * size) & (bold == was_bold) & ~begins & ragged)
    no = ~full | (F.abs(F.col("size") - F.col("_p.size")) > 0.6) | last["leads"] | (bold & ~was_bold & begins)
    aligned = F.abs(F.col("x0") - F.col("_p.x0")) <= 0.8 * size
    next_page = (F.col("page") == F.col("_p.page") + 1) & (bold == was_bold) & ((F.col("x0") <= F.col("margin") + 0.6 * size) | (~begins & (mid | (F.lit(not first) & aligned))))
    far = F.col("y0") - F.col("_p.y1") > F.greatest(1.2 * size, F.col("gap") + 0.8 * size)
    indented = F.lit(first) & (F.col("_p.x0") > F.col("_p.margin") + 0.8 * size) & aligned
    same_page = ~far & ~(~mid & (begins | indented)) & (F.lit(first) | (mid & ~begins) | aligned)
    return F.coalesce(F.when(no, False).when(F.col("page") != F.col("_p.page"), next_page).otherwise(same_page), F.lit(False))


def carried(rows: DataFrame, keys: list[str], order: list[str], after_no: str, after_yes: str) -> Column:
    """A bit along each key: of the two answers of a row, the one for the bit of the row before (no for the first row)."""
    along = Window.partitionBy(*keys).orderBy(*order)
    fixed = F.col(after_no) == F.col(after_yes)
    # The last row whose answers agree, and how often rows since then turn the bit round.
    turns = F.sum((~fixed & F.col(after_no)).cast("long")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    since = F.last(F.when(fixed, F.struct(F.col(after_no).alias("bit"), turns.alias("turns"))), True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start, before = F.coalesce(since["bit"], F.lit(False)), F.coalesce(since["turns"], F.lit(0))
    return start != ((turns - before) % 2 == 1)


def put_together(texts: Column) -> Column:
    """Texts, none of them empty or with blanks around it, as one: with a space between letters and digits. Ends are those of single texts, so long ones cost no more."""
    spaced = lambda t, i: (i > 0) & F.substring(F.get(texts, i - 1), -1, 1).rlike(LATIN_END) & t.rlike(LATIN_START)
    return F.array_join(F.transform(texts, lambda t, i: F.when(spaced(t, i), F.concat(F.lit(" "), t)).otherwise(t)), "")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, paragraph, page, pos, lines, text): lines of pages put together to paragraphs, numbered from 0 in each document.

    lines: see `page_measures`; those in tables are left out. Pages and places give the order. Text is joined without a space
    between ideographs and with one between letters and digits. Null texts are empty.
    """
    rows = lines.withColumn("text", text_of(F.col("text"))).filter(~F.col("in_table")).join(page_measures(lines.withColumn("text", text_of(F.col("text")))), ["doc_id", "page"])
    along = Window.partitionBy("doc_id").orderBy("page", "pos")
    fields = F.struct("page", "x0", "x1", "y1", "size", "bold", "right", "margin", "looks")
    rows = rows.withColumn("looks", looks(F.col("text"))).withColumn("_p", F.lag(fields).over(along)).withColumn("_b", F.lag(F.struct("x1"), 2).over(along))
    answer = lambda first: F.col("_p").isNotNull() & goes_on(first, F.col("looks"), F.col("_p.looks"))
    rows = rows.withColumn("_no", answer(True)).withColumn("_yes", answer(False))
    rows = rows.withColumn("_on", carried(rows, ["doc_id"], ["page", "pos"], "_no", "_yes"))
    rows = rows.withColumn("paragraph", F.sum((~F.col("_on")).cast("int")).over(along) - 1)
    parts = F.array_sort(F.collect_list(F.struct("page", "pos", stripped(F.col("text")).alias("text"))))
    joined = let(F.filter(F.transform("_parts", lambda p: p["text"]), lambda t: t != ""), put_together)
    each = rows.groupBy("doc_id", "paragraph").agg(parts.alias("_parts"))
    return each.select("doc_id", "paragraph", F.get("_parts", F.lit(0))["page"].alias("page"), F.get("_parts", F.lit(0))["pos"].alias("pos"), F.size("_parts").alias("lines"), cleaned(joined).alias("text"))
