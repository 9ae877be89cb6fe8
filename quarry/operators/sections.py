"""Section trees, tables and lines of parsed documents, given as rows (doc_id, pos, ...) in document order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped, text_of

# Forms of headings, the deepest level first; line ends and beginnings that no heading has; numbering classes.
HEADINGS = {
    3: (r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}", "[0-9]{1,2}[）)]", "[（(][0-9]{1,2}[）)]"),
    2: (r"[0-9]{1,2}\.[0-9]{1,2}", "[（(][一二三四五六七八九十]+[）)]"),
    1: ("第[一二三四五六七八九十百0-9]+[章节篇部]", "[一二三四五六七八九十]+[、.．]", r"[0-9]{1,2}\s+[\p{L}_]", "[0-9]{1,2}[、.．]"),
}
NO_HEADING = r"[，,；;、]$|^(?:19|20)[0-9]{2}\s*年|^[0-9]+\s*(?:万|千|亿|元|个|条|家|台|套)"
HEADING_CHARS = (2, 60)
NUMBERING = {
    "part": "第[一二三四五六七八九十百0-9]+[篇部章]", "cn": "[一二三四五六七八九十]+、", "cn_paren": "[（(][一二三四五六七八九十]+[）)]", "num3": r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}",
    "num2": r"[0-9]{1,2}\.[0-9]{1,2}(?:[^.0-9]|$)", "num1": "[0-9]{1,2}[.、．](?:[^0-9]|$)", "num_paren": "[（(][0-9]{1,2}[）)]",
}
PREFACE = -1


def heading_level(line: Column) -> Column:
    """Level 1 to 3 of a line that looks like a heading, else null."""
    t = stripped(text_of(line))
    level = F.when(~F.length(t).between(*HEADING_CHARS) | t.rlike(NO_HEADING), F.lit(None).cast("int"))
    for n, forms in HEADINGS.items():
        level = level.when(t.rlike(f"^(?:{'|'.join(forms)})"), n)
    return level


def numbering_class(title: Column) -> Column:
    t = F.regexp_replace(text_of(title), "^[※★▲◆ ]+", "")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, form in NUMBERING.items():
        out = out.when(t.rlike(f"^(?:{form})"), name)
    return out


def majority_levels(headings: DataFrame) -> DataFrame:
    """doc_id, numbering, level: the level that most headings of a numbering class have; two samples at least, the smaller level on a tie."""
    votes = headings.withColumn("numbering", numbering_class(F.col("title"))).filter("numbering IS NOT NULL").groupBy("doc_id", "numbering", "level").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc_id", "numbering").agg(F.sum("n").alias("all"), F.max_by("level", F.struct("n", -F.col("level"))).alias("level"))
    return best.filter("all >= 2").select("doc_id", "numbering", "level")


def climb(levels: list[int], titles: list[str]) -> list[dict]:
    """Parent (its number, PREFACE for what stands before the first heading, null for a root) and path of every heading of a document."""
    open_, out = [(1, PREFACE, "")], []
    for n, (level, title) in enumerate(zip(levels, titles, strict=True)):
        open_ = [x for x in open_ if x[0] < level]
        out.append({"parent": open_[-1][1] if open_ else None, "path": " > ".join([t for _, _, t in open_ if t] + [title])})
        open_.append((level, n, title))
    return out


def section_tree(headings: DataFrame) -> DataFrame:
    """doc_id, section (number in the document), pos, level, title, parent (section number) and path, from rows (doc_id, pos, level, title).

    The parent is the last heading before of a smaller level. The headings of one document are folded together, in one pass.
    """

    @F.pandas_udf("array<struct<parent:int,path:string>>")
    def places(levels: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([climb(list(a), list(b)) for a, b in zip(levels, titles, strict=True)], dtype=object)

    one = F.array_sort(F.collect_list(F.struct("pos", F.col("level").cast("int").alias("level"), text_of(F.col("title")).alias("title")))).alias("own")
    docs = headings.groupBy("doc_id").agg(one).withColumn("places", places("own.level", "own.title"))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip("own", "places")).alias("section", "x"))
    return rows.select("doc_id", "section", "x.own.pos", "x.own.level", "x.own.title", "x.places.parent", "x.places.path")


def in_sections(rows: DataFrame) -> DataFrame:
    """rows (doc_id, pos, kind, ...) with section: the number of the last heading before or at them, PREFACE before the first."""
    upto = Window.partitionBy("doc_id").orderBy("pos")
    return rows.withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(upto).cast("int") - 1)


def before_tables(rows: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, pos and context of every table: the last paragraphs of its section before it, in order."""
    own = Window.partitionBy("doc_id", "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = in_sections(rows).withColumn("_number", F.coalesce(F.sum((F.col("kind") == "paragraph").cast("int")).over(own), F.lit(0)))
    said = placed.filter("kind = 'paragraph'").select("doc_id", "section", (F.col("_number") + 1).alias("_number"), F.col("text").alias("_said"))
    tables = placed.filter("kind = 'table'").select("doc_id", "pos", "section", "_number")
    near = tables.filter("_number > 0").withColumn("_number", F.explode(F.sequence(F.greatest(F.col("_number") - (most - 1), F.lit(1)), F.col("_number"))))
    found = near.join(said, ["doc_id", "section", "_number"]).groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("_number", "_said"))).alias("found"))
    context = F.coalesce(F.array_join(F.transform("found", lambda x: x["_said"]), "\n"), F.lit(""))
    return tables.select("doc_id", "pos").join(found, ["doc_id", "pos"], "left").select("doc_id", "pos", context.alias("context"))


def table_markdown(grid: Column) -> Column:
    """A table (array of rows of cells) as Markdown: the first row is the head, other rows are cut or filled to its width."""
    width = F.size(F.get(grid, F.lit(0)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    full = lambda cells: F.slice(F.concat(F.transform(cells, text_of), F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)))), F.lit(1), width)
    body = F.transform(F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0))), lambda r: line(full(r)))
    return F.when((F.coalesce(F.size(grid), F.lit(0)) < 1) | (width < 1), "").otherwise(F.array_join(F.concat(F.array(line(full(F.get(grid, F.lit(0)))), line(F.array_repeat(F.lit("---"), width))), body), "\n"))


def line_gaps(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, pos, top, bottom) with gap: the distance from the line before on the same page, null for a page's first."""
    return lines.withColumn("gap", F.col("top") - F.lag("bottom").over(Window.partitionBy("doc_id", "page").orderBy("pos")))


def edge_clusters(values: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, cluster, center, n: runs of values with no more than `tolerance` between neighbours, and their means."""
    along = Window.partitionBy(*keys).orderBy(value)
    marked = values.withColumn("_new", (F.coalesce(F.col(value) - F.lag(value).over(along), F.lit(float("inf"))) > tolerance).cast("int"))
    runs = marked.withColumn("cluster", F.sum("_new").over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*keys, "cluster").agg(F.round(F.avg(value), 6).alias("center"), F.count("*").alias("n"))


def collapsed(rows: DataFrame, keys: list[str], around: int = 2) -> DataFrame:
    """Diff rows (keys, pos, type) without the middle of long runs of `same` rows, which becomes one row `gap` with its count.

    A run keeps `around` rows beside each change; one that would lose a single row stays whole.
    """
    along, whole = Window.partitionBy(*keys).orderBy("pos"), Window.partitionBy(*keys)
    runs = rows.withColumn("_run", F.sum((F.col("type") != "same").cast("int")).over(along)).withColumn("_same", F.col("type") == "same")
    own = Window.partitionBy(*keys, "_run", "_same")
    runs = runs.withColumn("_n", F.count("*").over(own)).withColumn("_i", F.row_number().over(own.orderBy("pos"))).withColumn("_last", F.max("_run").over(whole))
    # A run's head is kept after a change, its tail before one: the first run may have no change before it, the last none after.
    head = F.when(F.col("_run") == 0, 0).otherwise(around)
    tail = F.when(F.col("_run") == F.col("_last"), 0).otherwise(around)
    cut = F.col("_same") & (F.col("_n") > head + tail + 1) & (F.col("_i") > head) & (F.col("_i") <= F.col("_n") - tail)
    kept = runs.withColumn("_cut", cut).filter(~F.col("_cut") | (F.col("_i") == head + 1))
    return kept.select(*keys, "pos", F.when(F.col("_cut"), "gap").otherwise(F.col("type")).alias("type"), F.when(F.col("_cut"), F.col("_n") - head - tail).cast("long").alias("count"))


def source_note(kind: Column, pages: Column, mode: Column, ignored: Column, warnings: Column) -> Column:
    """What is said of a parsed source: pages and how its sections were found, then warnings; nothing but for page layouts."""
    said = F.when((mode == "layout") & F.coalesce(ignored, F.lit(False)), "bookmarks do not fit, sections by layout").when(mode == "bookmarks", "sections by bookmarks").when(mode == "layout", "no bookmarks, sections by layout")
    first = F.concat_ws(", ", F.concat(F.coalesce(pages, F.lit(0)), F.lit(" pages")), said)
    return F.when(kind == "pdf", F.concat_ws("; ", first, F.array_join(F.coalesce(warnings, F.array().cast("array<string>")), "; "))).otherwise("")


def without_title(content: Column, title: Column) -> Column:
    """Content without a first line that is a heading and repeats the section's title."""
    body = F.regexp_replace(text_of(content), r"\A\n+", "")
    first, rest = F.element_at(F.split(body, "\n", 2), 1), F.coalesce(F.get(F.split(body, "\n", 2), F.lit(1)), F.lit(""))
    core = lambda t: F.regexp_replace(F.regexp_replace(text_of(t), r"[#*\s]", ""), r"^(?:第[一二三四五六七八九十百0-9]+[章节篇]|[0-9.]+|[一二三四五六七八九十]+[、.．])", "")
    heading, own = core(first), core(title)
    repeats = first.rlike(r"^\s*(?:#{1,6}\s*.+|\*\*.+\*\*)\s*$") & (heading != "") & (own != "") & F.contains(heading, own)
    return F.when(repeats, F.regexp_replace(rest, r"\A\n+", "")).otherwise(text_of(content))


def excerpt_place(content: Column, excerpt: Column, line: Column) -> Column:
    """Start (from 0) of an excerpt without its dots in a text, in the given line if it is there, else the first; null if nowhere."""
    needle = stripped(F.regexp_replace(text_of(excerpt), "^…+|…+$", ""))
    own = F.get(F.split(content, "\n", -1), line - 1)
    before = F.length(F.array_join(F.slice(F.split(content, "\n", -1), F.lit(1), F.greatest(line - 1, F.lit(0))), "\n")) + F.when(line > 1, 1).otherwise(0)
    here, first = F.instr(own, needle), F.instr(content, needle)
    return F.when((text_of(content) == "") | (needle == ""), F.lit(None)).when((line > 0) & (here > 0), before + here - 1).when(first > 0, first - 1).cast("long")
