"""Flow charts written as text: their nodes and edges as tables, large ones cut into parts that keep what crosses between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped, text_of

# The form of a chart, of a node, lines that are not read, nodes of a chart and of a part, long labels.
FIRST_LINE = r"^(?:graph|flowchart)\s+(?:TD|TB|LR|RL|BT)\s*;?$"
NODE = r"^([A-Za-z_][\w-]*)(?:\[([^\]]*)\]|\(([^)]*)\)|\{([^}]*)\})?$"
NOT_READ = r"^(?:style|classDef|class|click|linkStyle|direction)\b"
FRONT_MATTER = r"(?s)\A\s*---\s*\n.*?\n---\s*\n"
MOST_NODES, PART_NODES, MOST_LABEL, REST = 10, 6, 24, "其他节点"
KEY = ["diagram_id"]


def lines_of(diagrams: DataFrame) -> DataFrame:
    """(diagram_id, n, line): lines that are not blank or comments, trimmed."""
    each = F.transform(F.split(F.regexp_replace(text_of(F.col("code")), FRONT_MATTER, ""), "\n"), stripped)
    return diagrams.select("diagram_id", F.posexplode(F.filter(each, lambda x: (x != "") & ~F.startswith(x, F.lit("%%")))).alias("n", "line"))


def part_of(text: Column, k: int) -> Column:
    return F.regexp_extract(text, NODE, k)


def parsed(diagrams: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (diagram_id, ident, label, group, place), edges (diagram_id, n, i, from, to, label), and read (diagram_id, readable).

    diagrams: diagram_id, code. A chart is readable if its first line names it, its groups are closed and all other lines are
    nodes, edges or groups; charts that are not have no nodes and edges. A node's label is the last one given to it; its
    group is the first named group (in the order of the chart) that it stands in, or null.
    """
    rows = lines_of(diagrams)
    along = Window.partitionBy("diagram_id").orderBy("n")
    opens, closes = F.startswith("line", F.lit("subgraph ")), F.col("line") == "end"
    depth = F.sum(opens.cast("int") - closes.cast("int")).over(along)
    rows = rows.withColumn("_open", opens).withColumn("_depth", depth)
    # The group of a line is the last one opened at its depth.
    rows = rows.withColumn("_group", F.when(F.col("_depth") > 0, F.last(F.when(F.col("_open"), F.struct(stripped(F.substring("line", 10, 1 << 30)).alias("name"), "n")), True).over(Window.partitionBy("diagram_id", "_depth").orderBy("n"))))
    body = rows.filter("n > 0 AND NOT _open AND line != 'end'")
    pieces = F.transform(F.split("line", "-->"), lambda x: stripped(x))
    labelled = lambda x: x.rlike(r"^\|[^|]*\|")
    bare = lambda x: stripped(F.regexp_replace(stripped(F.regexp_replace(x, r"^\|[^|]*\|", "")), ";$", ""))
    parts = F.transform(pieces, lambda x, i: F.struct(F.when((i > 0) & labelled(x), F.regexp_extract(x, r"^\|([^|]*)\|", 1)).otherwise("").alias("edge"), F.when(i > 0, bare(x)).otherwise(stripped(F.regexp_replace(x, ";$", ""))).alias("node")))
    each = body.select("diagram_id", "n", "_group", F.posexplode(parts).alias("i", "p")).select("diagram_id", "n", "_group", "i", F.col("p.edge").alias("edge"), F.col("p.node").alias("node"))
    first = rows.filter("n = 0").select("diagram_id", F.col("line").rlike(FIRST_LINE).alias("_named"))
    lowest = rows.groupBy("diagram_id").agg(F.min("_depth").alias("_low"), F.max_by("_depth", "n").alias("_last"), F.bool_or((F.col("n") > 0) & F.col("line").rlike(NOT_READ)).alias("_other"))
    fit = each.groupBy("diagram_id").agg(F.bool_and(F.col("node").rlike(NODE)).alias("_nodes"))
    ok = F.coalesce(F.col("_named") & (F.col("_low") >= 0) & (F.col("_last") == 0) & ~F.col("_other") & F.col("_nodes"), F.lit(False))
    read = diagrams.select("diagram_id").join(first, "diagram_id", "left").join(lowest, "diagram_id", "left").join(fit, "diagram_id", "left").select("diagram_id", ok.alias("readable"))
    good = each.join(read.filter("readable").select("diagram_id"), "diagram_id", "left_semi")
    given = F.when(F.col("node").rlike(r"[\[({]"), F.concat(part_of(F.col("node"), 2), part_of(F.col("node"), 3), part_of(F.col("node"), 4)))
    named = good.withColumn("ident", part_of(F.col("node"), 1)).withColumn("_label", F.btrim(given, F.lit('"')))
    at = F.struct("n", "i")
    # Groups are in the order in which a node was first put into one of their name.
    names = named.filter("_group IS NOT NULL").groupBy("diagram_id", F.col("_group.name").alias("_name")).agg(F.min(at).alias("_rank"))
    grouped = named.filter("_group IS NOT NULL").groupBy("diagram_id", F.col("_group.name").alias("_name"), "ident").agg(F.min(at).alias("_in")).join(names, ["diagram_id", "_name"])
    home = grouped.groupBy("diagram_id", "ident").agg(F.min_by(F.struct(F.col("_name").alias("name"), "_rank", "_in"), "_rank").alias("_home"))
    nodes = named.groupBy("diagram_id", "ident").agg(F.max_by("_label", F.when(F.col("_label").isNotNull(), at)).alias("_label"), F.min(at).alias("_at")).join(home, ["diagram_id", "ident"], "left")
    order = Window.partitionBy("diagram_id").orderBy(F.col("_home._rank").asc_nulls_last(), F.coalesce("_home._in", "_at"))
    nodes = nodes.select("diagram_id", "ident", F.coalesce("_label", "ident").alias("label"), F.col("_home.name").alias("group"), F.row_number().over(order).alias("place"))
    before = F.lag("ident").over(Window.partitionBy("diagram_id", "n").orderBy("i"))
    edges = named.withColumn("from", before).filter("i > 0").select("diagram_id", "n", "i", "from", F.col("ident").alias("to"), F.col("edge").alias("label"))
    return nodes, edges, read


def parts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with part (group, then number), and edges with inner: whether both ends are in one part; charts of MOST_NODES nodes or fewer are one part.

    An edge that crosses stays a row, with the parts of both its ends, so nothing is lost.
    """
    own = Window.partitionBy("diagram_id", F.coalesce("group", F.lit(REST)))
    size = F.count("*").over(Window.partitionBy("diagram_id"))
    number = F.floor((F.row_number().over(own.orderBy("place")) - 1) / PART_NODES) + 1
    title = F.when(size > MOST_NODES, F.concat(F.coalesce("group", F.lit(REST)), F.lit(" "), number.cast("string"))).otherwise("1")
    placed = nodes.withColumn("part", title)
    at = placed.select("diagram_id", "ident", "part")
    both = edges.join(at.select("diagram_id", F.col("ident").alias("from"), F.col("part").alias("from_part")), ["diagram_id", "from"]).join(at.select("diagram_id", F.col("ident").alias("to"), F.col("part").alias("to_part")), ["diagram_id", "to"])
    return placed, both.withColumn("inner", F.col("from_part") == F.col("to_part"))


def checks(nodes: DataFrame, read: DataFrame) -> DataFrame:
    """(diagram_id, nodes, unreadable, dense, long_labels): what a reader should look at in each chart."""
    sums = nodes.groupBy("diagram_id").agg(F.count("*").alias("nodes"), F.bool_or(F.length("label") > MOST_LABEL).alias("long_labels"))
    rows = read.join(sums, "diagram_id", "left")
    return rows.select("diagram_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), (~F.col("readable")).alias("unreadable"), F.coalesce(F.col("nodes") > MOST_NODES, F.lit(False)).alias("dense"), F.coalesce("long_labels", F.lit(False)).alias("long_labels"))
