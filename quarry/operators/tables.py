"""Tables that go on over page breaks: which tables are one, which rows were cut in two, and the rows as they were meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped, text_of
from .layout import LATIN_END, LATIN_START, cleaned
from .matching import let

# How far edges of columns may lie apart, and ends of sentences after which a cell's next line stands apart.
EDGE_TOLERANCE, SENTENCE_STOP = 3.0, "[。；;！!？?]$"
#: Rows of tables that a task holds, about; tasks follow the input, not the session's number of partitions.
TASK_ROWS = 500_000


def stitched(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, head): of each table the first one of those that it continues, itself if none.

    blocks: doc_id, seq, page, edges (of columns, null for what is no table), first_on_page, last_on_page. A table continues
    the one right before it if that is the last block of the page before, it is the first of its own, and it has the column
    edges of the head, give or take EDGE_TOLERANCE. The tables of a document meet in its row.
    """
    along = Window.partitionBy("doc_id").orderBy("seq")
    is_table, fields = F.col("edges").isNotNull(), F.struct("page", "last_on_page")
    rows = blocks.withColumn("_after", F.lag(is_table, 1, False).over(along)).withColumn("_before", F.lag(fields).over(along)).filter(is_table)
    meets = F.col("_after") & (F.col("page") == F.col("_before.page") + 1) & F.col("_before.last_on_page") & F.col("first_on_page")
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce(meets, F.lit(False)).alias("meets"), "edges"))).alias("own"))
    alike = lambda a, b: (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= EDGE_TOLERANCE), lambda near: near)
    head = lambda t: F.struct(t["seq"].alias("seq"), t["seq"].alias("head"), t["edges"].alias("edges"))

    def step(found: Column, t: Column) -> Column:
        last = F.element_at(found, -1)
        goes_on = (F.size(found) > 0) & t["meets"] & alike(last["edges"], t["edges"])
        return F.concat(found, F.array(F.when(goes_on, F.struct(t["seq"].alias("seq"), last["head"].alias("head"), last["edges"].alias("edges"))).otherwise(head(t))))

    folded = F.aggregate("own", F.transform(F.slice("own", 1, 0), head), step)
    return own.select("doc_id", F.explode(folded).alias("t")).select("doc_id", "t.seq", "t.head")


def filled(text: Column) -> Column:
    return stripped(text_of(text)) != ""


def was_cut(above: Column, row: Column, open_: Column) -> Column:
    """Whether a row (array of cells: text, cut, bottom, strong) is the rest of the row above; open_ tells in which columns that has text.

    Every column with text goes on with a cell that was cut (or, if some cell of the row above was surely cut, that reaches its
    bottom), and in some column the row above had been finished.
    """
    whole = F.exists(above, lambda c: c["strong"])
    each = F.transform(row, lambda c, i: F.struct(filled(c["text"]).alias("said"), F.coalesce(F.get(open_, i), F.lit(False)).alias("before"), F.coalesce(F.get(above, i)["cut"] | (whole & F.get(above, i)["bottom"]), F.lit(False)).alias("goes_on")))
    return ~F.exists(each, lambda c: c["said"] & ~(c["before"] & c["goes_on"])) & F.exists(each, lambda c: ~c["said"] & c["before"])


def joined_rows(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, head, row, cells): rows of tables over page breaks as they were meant, numbered from 0; heads as of `stitched`.

    rows: doc_id, seq, r, cells (array of text, cut, bottom, strong). A first row that repeats the head's first row is dropped.
    A first row that is the rest of a row cut in two is put onto that; in another first row an empty cell goes on with the one
    above it. Rows without text are dropped. The rows of one table meet in its row, and all is told there: cells are dealt out
    twice, to their block's head and to their table.
    """
    n_parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    placed = rows.repartition(n_parts, "doc_id", "seq").join(heads.repartition(n_parts, "doc_id", "seq"), ["doc_id", "seq"])
    # The key is one column: a head that is the same everywhere would be put in as a constant, and rows be dealt out once more.
    keyed = placed.select(F.struct("doc_id", "head").alias("_table"), F.struct("seq", "r", "cells").alias("_row")).repartition(n_parts, "_table")
    lists = keyed.groupBy("_table").agg(F.array_sort(F.collect_list("_row")).alias("_all")).select("_table.doc_id", "_table.head", "_all")
    texts = lambda x: F.transform(x["cells"], lambda c: text_of(c["text"]))
    starts = lambda own, x, i: (i == 0) | (F.get(own, i - 1)["seq"] != x["seq"])
    repeats = lambda own, x, i: (x["seq"] != F.col("head")) & starts(own, x, i) & (texts(x) == texts(F.get(own, F.lit(0)))) & F.exists(texts(x), lambda t: t != "")
    kept = let(F.col("_all"), lambda own: F.filter(own, lambda x, i: ~repeats(own, x, i)))
    marked = let(kept, lambda own: F.transform(own, lambda x, i: F.struct(((x["seq"] != F.col("head")) & starts(own, x, i)).alias("starts"), x["cells"].alias("cells"))))
    presence = lambda cells: F.transform(cells, lambda c: filled(c["text"]))
    said = lambda cells: F.transform(cells, lambda c: stripped(text_of(c["text"])))
    # A row so far: the cells of its last part, where its first part has text, its texts, the columns of its first part, and whether that is the first of a page.
    alone = lambda x: F.struct(x["cells"].alias("cells"), presence(x["cells"]).alias("open"), said(x["cells"]).alias("texts"), F.size(x["cells"]).alias("width"), x["starts"].alias("starts"))
    gap = lambda out, t: F.when((out.rlike(LATIN_END) & t.rlike(LATIN_START)) | out.rlike(SENTENCE_STOP), " ").otherwise("")
    put = lambda out, t: F.when(text_of(t) == "", text_of(out)).when(text_of(out) == "", t).otherwise(F.concat(out, gap(out, t), t))

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        rest = x["starts"] & was_cut(last["cells"], x["cells"], last["open"])
        longer = F.struct(x["cells"].alias("cells"), last["open"].alias("open"), F.zip_with(last["texts"], said(x["cells"]), put).alias("texts"), last["width"].alias("width"), last["starts"].alias("starts"))
        return F.when((F.size(done) > 0) & rest, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(alone(x))))

    whole = let(marked, lambda own: F.aggregate(own, F.transform(F.slice(own, 1, 0), alone), step))
    told = F.transform(F.filter(whole, lambda d: d["texts"].isNotNull()), lambda d: F.struct(d["starts"].alias("starts"), d["width"].alias("width"), F.transform(d["texts"], cleaned).alias("texts")))
    above = lambda own, k, i: F.get(F.try_element_at(F.filter(F.slice(own, 1, k), lambda d: F.size(d["texts"]) > i), F.lit(-1))["texts"], i)
    full = lambda own, d, k: F.transform(d["texts"], lambda t, i: F.when(d["starts"] & (i < d["width"]) & (t == ""), F.coalesce(above(own, k, i), F.lit(""))).otherwise(t))
    cells = let(told, lambda own: F.transform(own, lambda d, k: full(own, d, k)))
    return lists.select("doc_id", "head", F.posexplode(F.filter(cells, lambda row: F.exists(row, lambda t: t != ""))).alias("row", "cells"))
