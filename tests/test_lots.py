"""What Python tells from texts: bounded lots, one worker a task, the same answers as text by text."""

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import lots
from quarry.operators import claims, commitments, quantities


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lots():
    texts = pa.array(["a" * 100_000, None, "b" * 200_000, "c" * 900_000, "d"] + ["e"] * 600)
    found = list(lots.lots(texts))
    assert [i for i, _ in found[1:]] == [j for _, j in found[:-1]] and found[0][0] == 0 and found[-1][1] == len(texts)
    assert found[:3] == [(0, 2), (2, 3), (3, 4)] and max(j - i for i, j in found) == lots.MOST_TEXTS
    assert list(lots.lots(pa.array([], pa.string()))) == []


def test_one_worker_a_task(spark):
    """Code and marks are blanked where texts are read: no second Python worker in the task."""
    rows = spark.createDataFrame([(1, "```x```\n大概 2小时响应【待填写】")], "section_id int, text string").repartition(1)
    assert plan(claims.wording(rows)).count("ArrowEvalPython") == 1
    facts = spark.createDataFrame([], "topic string, scope string, dimension string, number double, value string, approx boolean, comparator string")
    assert plan(commitments.check_commitments(rows, facts)).count("ArrowEvalPython") == 1


def test_lots_of_rows(spark):
    """More rows than a lot, of several batches: each row has its own answer."""
    rows = spark.range(3000).repartition(2).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("```5天```大概"), "id", F.lit("天内完工，可能"))).alias("text"))
    found = {r.id: [(q.topic, q.number, q.start) for q in r.q] for r in rows.select("id", quantities.extracted(F.col("text"), hidden=("```.*?```",)).alias("q")).collect()}
    assert found == {i: [("duration", float(i), 10)] if i % 7 else [] for i in range(3000)}
    said = claims.wording(rows.withColumnRenamed("id", "section_id")).groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "code"))).alias("all")).collect()
    assert {r.section_id: [tuple(x) for x in r["all"]] for r in said} == {i: [(8, 10, "weak_phrase"), (15 + len(str(i)), 17 + len(str(i)), "weak_phrase")] for i in range(3000) if i % 7}
