"""Names in texts and texts without them, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import BLANKS
from ..operators import dictionary
from ..sources.tables import table
from .registry import query


def gone(text: str) -> str:
    """SQL for a text without blanks."""
    return f"regexp_replace({text}, '[{BLANKS}]+', '', 'g')"


@query(f"""WITH t AS (SELECT doc_id, {gone("coalesce(text, '')")} AS t FROM documents), n AS (SELECT unnest(['the', 'und', 'les', 'que']) AS name)
SELECT doc_id, name, CAST((length(t) - length(replace(t, name, ''))) / length(name) AS BIGINT) AS n FROM t, n WHERE contains(t, name)""")
def name_occurrences(spark, sf_dir):
    """Names of two characters or more in whole documents, blanks aside; of two at a place the longer counts."""
    names = spark.createDataFrame([("the",), ("u nd",), ("les",), ("que",), ("x",)], "term string").filter(F.length("term") >= 2)
    found = dictionary.occurrences(names, table(spark, sf_dir, "documents"), "doc_id", blanks=False)
    return dictionary.longest_first(found, "doc_id").groupBy("doc_id", F.regexp_replace("term", " ", "").alias("name")).agg(F.count("*").alias("n"))


#: Words of nine letters or more and each text's second and third word as names: some overlap, some have a blank inside.
NAMES = """SELECT DISTINCT lower(""" + gone("name") + """) AS form FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS name FROM benchmark UNION ALL
SELECT regexp_extract(text, '^[^ ]+ ([^ ]+ [^ ]+)', 1) FROM benchmark UNION ALL SELECT regexp_extract(text, '^[^ ]+ [^ ]+ ([^ ]+ [^ ]+)', 1) FROM benchmark) WHERE name IS NOT NULL AND name != ''"""


def hidden_names(spark, sf_dir):
    text = F.col("text")
    found = F.concat(F.regexp_extract_all(text, F.lit("[A-Za-z]{9,}"), F.lit(0)), F.array(F.regexp_extract(text, "^[^ ]+ ([^ ]+ [^ ]+)", 1), F.regexp_extract(text, "^[^ ]+ [^ ]+ ([^ ]+ [^ ]+)", 1)))
    return table(spark, sf_dir, "benchmark").select(F.explode(found).alias("term"))


RUNS = f"""WITH n AS ({NAMES}), t AS (SELECT doc_id, text, string_split(coalesce(text, ''), '') AS letters, lower({gone("coalesce(text, '')")}) AS bare FROM documents),
p AS (SELECT doc_id, bare, list_filter(generate_series(1, len(letters)), lambda i: NOT regexp_matches(letters[i], '[{BLANKS}]')) AS spots FROM t),
m AS (SELECT doc_id, bare, spots, form, string_split(bare, form) AS parts FROM p JOIN n ON contains(bare, form)),
w AS (SELECT doc_id, bare, spots, form, unnest(list_transform(generate_series(1, len(parts) - 1), lambda k: CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) AS BIGINT) + (k - 1) * length(form) + 1)) AS first FROM m),
v AS (SELECT doc_id, spots, form, first + s AS i FROM w, generate_series(0, 40) g(s) WHERE s < length(form) AND substr(bare, first + s, length(form)) = form),
o AS (SELECT doc_id, spots[i] - 1 AS a, spots[i + length(form) - 1] AS b FROM v),
r AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
g AS (SELECT *, sum(CASE WHEN coalesce(reach, -1) < a THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM r),
s AS (SELECT doc_id, run, min(a) AS a, max(b) AS b FROM g GROUP BY ALL) """


@query(RUNS + "SELECT doc_id, a AS start, b AS \"end\" FROM s")
def hidden_runs(spark, sf_dir):
    """Where names stand in whole documents, blanks and case aside; runs of overlapping or touching ones as one."""
    found = dictionary.occurrences(hidden_names(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", blanks=False, fold=True)
    return dictionary.runs(found, "doc_id")


@query(RUNS + f""", c AS (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM s),
e AS (SELECT doc_id, string_agg(substr(text, z + 1, a - z) || '{dictionary.MARK}', '' ORDER BY a) AS head FROM c JOIN t USING (doc_id) GROUP BY doc_id), l AS (SELECT doc_id, max(b) AS z, count(*) AS n FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN text ELSE head || substr(text, z + 1) END AS text, CAST(coalesce(n, 0) AS INT) AS n_hidden FROM t LEFT JOIN e USING (doc_id) LEFT JOIN l USING (doc_id)""")
def redacted_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dictionary.redacted(docs, hidden_names(spark, sf_dir), "doc_id")
