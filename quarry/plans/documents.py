"""Tables over pages, bookmarks and flow charts, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bookmarks, diagrams, tables
from ..sources.tables import paragraphs, table
from .registry import query

# Orders of a customer as blocks, one a page; every fifth is no table, every third does not end its page.
BLOCKS = "SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS seq, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS shape, o_orderkey % 3 != 0 AS ends FROM orders"


@query(f"""WITH b AS ({BLOCKS}), l AS (SELECT *, lag(shape) OVER w AS before, lag(ends) OVER w AS ended FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
s AS (SELECT doc_id, seq, sum(CASE WHEN shape = before AND ended THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS chain FROM l WHERE shape IS NOT NULL)
SELECT doc_id, seq, min(seq) OVER (PARTITION BY doc_id, chain) AS head FROM s""")
def stitched_tables(spark, sf_dir):
    status = F.col("o_orderstatus")
    left = F.when(status == "O", 80.0).when(status == "P", 52.0).otherwise(50.0)
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    blocks = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), seq.alias("seq"), seq.alias("page"), F.when(F.col("o_orderkey") % 5 != 0, F.array(left, F.lit(200.0))).alias("edges"), F.lit(True).alias("first_on_page"), (F.col("o_orderkey") % 3 != 0).alias("last_on_page"),
    )
    return tables.stitched(blocks)


ROW_CELLS = "SELECT o_orderkey AS doc_id, o_orderstatus, concat('n', o_orderkey) AS name, o_orderpriority AS said FROM orders"


@query(f"""WITH o AS ({ROW_CELLS}), r AS (SELECT doc_id, 0 AS k, ['name', 'what'] AS cells FROM o UNION ALL SELECT doc_id, 1, [name, CASE WHEN o_orderstatus = 'F' THEN concat(said, '。and more') ELSE concat(said, '。') END] FROM o UNION ALL SELECT doc_id, 2, [name, 'and more'] FROM o WHERE o_orderstatus != 'F')
SELECT doc_id, CAST(0 AS INT) AS head, CAST(k AS INT) AS row, cells FROM r""")
def rows_over_pages(spark, sf_dir):
    """Orders as tables over two pages that repeat their head; where the order is finished the last row is cut in two."""
    cell = lambda text, cut=False: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), (F.lit(cut) if isinstance(cut, bool) else cut).alias("cut"), F.lit(False).alias("bottom"), F.lit(False).alias("strong"))
    head = F.array(cell("name"), cell("what"))
    said = F.concat("o_orderpriority", F.lit("。"))
    row = lambda seq, r, cells: F.struct(F.lit(seq).alias("seq"), F.lit(r).alias("r"), cells.alias("cells"))
    every = F.array(row(0, 0, head), row(0, 1, F.array(cell(F.concat(F.lit("n"), "o_orderkey")), cell(said, F.col("o_orderstatus") == "F"))), row(1, 0, head), row(1, 1, F.array(cell(""), cell("and more"))))
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(every).alias("x")).select("doc_id", "x.*")
    heads = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), F.lit(0).alias("head"))
    return tables.joined_rows(rows, heads)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS p FROM documents), m AS (SELECT *, regexp_matches(t, '[\\p{L}\\p{N}]') AS said FROM l WHERE p % 3 = 0)
SELECT doc_id, count_if(said) AS n FROM m GROUP BY doc_id HAVING count_if(said) >= greatest(3, 0.3 * count(*))""")
def bookmark_counts(spark, sf_dir):
    """Every third line of a document is a bookmark to itself: all that say something fit, in order."""
    rows = paragraphs(spark, sf_dir)
    page = F.floor(F.col("pos") / 5).cast("int")
    own = rows.select("doc_id", F.col("pos").alias("paragraph"), page.alias("page"), F.lit(1).alias("lines"), F.col("line").alias("text"))
    marks = rows.filter("pos % 3 = 0").select("doc_id", F.col("pos").alias("k"), F.lit(1).alias("level"), F.col("line").alias("title"), (page + 1).alias("page"))
    return bookmarks.covering(bookmarks.matched(marks, own), own).groupBy("doc_id").agg(F.count("*").alias("n"))


# Forty customers a chart, grouped by segment, each linked to the next.
CHART = "SELECT c_custkey // 40 AS diagram_id, concat('C', c_custkey) AS ident, c_name AS label, c_mktsegment AS seg, c_custkey, count(*) OVER (PARTITION BY c_custkey // 40) AS n FROM customer"
PLACED = f"c AS ({CHART}), p AS (SELECT *, CASE WHEN n > 10 THEN concat(seg, ' ', (row_number() OVER (PARTITION BY diagram_id, seg ORDER BY c_custkey) - 1) // 6 + 1) ELSE '1' END AS part FROM c)"


def charts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("diagram_id", F.floor(F.col("c_custkey") / 40))
    ident = F.concat(F.lit("C"), F.col("c_custkey"))
    own = rows.groupBy("diagram_id", "c_mktsegment").agg(F.concat(F.lit("subgraph "), "c_mktsegment", F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", F.concat(ident, F.lit("["), "c_name", F.lit("]")).alias("t")))), lambda x: x["t"]), "\n"), F.lit("\nend\n")).alias("t"))
    groups = own.groupBy("diagram_id").agg(F.array_join(F.array_sort(F.collect_list("t")), "").alias("groups"))
    links = rows.groupBy("diagram_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", ident.alias("t")))), lambda x: x["t"]), " --> ").alias("links"))
    return groups.join(links, "diagram_id").select("diagram_id", F.concat(F.lit("graph TD\n"), "groups", "links").alias("code"))


@query(f'WITH {PLACED} SELECT diagram_id, ident, label, seg AS "group", part FROM p')
def chart_parts(spark, sf_dir):
    nodes, edges, _ = diagrams.parsed(charts(spark, sf_dir))
    return diagrams.parts(nodes, edges)[0].drop("place")


@query(f"""WITH {PLACED}, e AS (SELECT diagram_id, part = lag(part) OVER (PARTITION BY diagram_id ORDER BY c_custkey) AS inside FROM p) SELECT diagram_id, count_if(inside) AS inside, count_if(NOT inside) AS crossing FROM e WHERE inside IS NOT NULL GROUP BY diagram_id""")
def chart_edges(spark, sf_dir):
    nodes, edges, _ = diagrams.parsed(charts(spark, sf_dir))
    return diagrams.parts(nodes, edges)[1].groupBy("diagram_id").agg(F.count_if("inner").alias("inside"), F.count_if(~F.col("inner")).alias("crossing"))


@query(f"WITH c AS ({CHART}) SELECT diagram_id, count(*) AS nodes, false AS unreadable, count(*) > 10 AS dense, max(length(label)) > 24 AS long_labels FROM c GROUP BY diagram_id")
def chart_checks(spark, sf_dir):
    nodes, _, read = diagrams.parsed(charts(spark, sf_dir))
    return diagrams.checks(nodes, read)
