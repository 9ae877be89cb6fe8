"""Quality rules by host: rules judge each text, failures are counted by host, rates are shrunk, and verdicts go back to the texts.

Everything is a built-in expression. Words, lines and windows of a text are judged in its row; only counts by host and rows
without text are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, only, stage

BLANKS, NOT_BLANK, SYMBOLS = r"[ \t-\r]+", r"[^ \t-\r]", r"[#*$%&|<>]"
#: A window of a text is sorted as one long: the high bits of its hash, and its place in so many low bits.
PLACE_BITS = 20
#: Rules whose failures are counted by host, and the share of a host's texts that may fail one of them.
RULES, MOST_FAILING = ("short", "repeated", "symbols", "copied_lines"), 0.5
#: A prior counts as so many texts at least and at most; posterior standard deviations below the mean that are compared.
LEAST_PRIOR, MOST_PRIOR, DEVIATIONS = 1.0, 10_000.0, 2.0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row, however often use names it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def covered(places: Column) -> Column:
    """Words that lie in a window of three words; places are the windows' first words, ascending."""
    return F.aggregate(F.transform(places, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)


def starts(words: Column) -> Column:
    """The words at which a window of three begins."""
    return F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def repeated_by_text(words: Column) -> Column:
    """Words in windows of three that occur twice or more, by sorting the windows' texts."""
    windows = F.transform(starts(words), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(words, i + 1), F.get(words, i + 2)).alias("k"), i.alias("p")))

    def places(s: Column) -> Column:
        return F.sort_array(F.filter(F.transform(s, lambda x, i: F.when((x.k == F.get(s, i - 1).k) | (x.k == F.get(s, i + 1).k), x.p)), lambda p: p.isNotNull()))

    return let(F.sort_array(windows), lambda s: let(places(s), covered))


def repeated_words(words: Column) -> Column:
    """The same by sorting longs: hash and place together. Windows of one hash are compared by their words; where two differ, or
    where places don't fit, texts are sorted instead."""
    low = (1 << PLACE_BITS) - 1

    def alike(a: Column, b: Column) -> Column:
        return F.shiftrightunsigned(a.bitwiseXOR(b), PLACE_BITS) == 0

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low)).cast("int")

    def three(p: Column) -> Column:
        return F.struct(F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))

    def checked(found: Column) -> Column:
        differ = F.exists(F.transform(found, lambda x, i: alike(x, F.get(found, i + 1)) & (three(place(x)) != three(place(F.get(found, i + 1))))), lambda d: d)
        return F.when(F.coalesce(differ, F.lit(False)), repeated_by_text(words)).otherwise(let(F.sort_array(F.transform(found, place)), covered))

    keys = F.transform(starts(words), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    by_hash = let(F.sort_array(keys), lambda s: let(F.filter(s, lambda x, i: alike(x, F.get(s, i + 1)) | alike(x, F.get(s, i - 1))), checked))
    return F.when(F.size(words) > low, repeated_by_text(words)).otherwise(by_hash)


def text_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """doc_id, host, the counts of every whole text, base_failed, and for each rule whether the text fails it; nothing is shuffled.

    Words are runs of other characters than blanks (space, \\t to \\r). word_chars: code points in words. n_symbols: characters of
    `#*$%&|<>`. n_dup_lines: lines that hold a word and equal an earlier line of the text. n_repeat_words: words in windows of
    three words that occur twice or more in the text. A null text has no words and fails as short. Rows repeat as in docs.
    """
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"), (F.lit(None) if host is None else host).cast("string").alias("host"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_BLANK))
    counts = let(words_of(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"), F.size(x).alias("n"))).alias("lines"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
    ))
    short, repeated = F.col("c.n_words") < 50, 100 * F.col("c.n_repeat_words") > 50 * F.col("c.n_words")
    return rows.select("doc_id", "host", counts.alias("c")).select(
        "doc_id", "host", "c.n_words", "c.word_chars", "c.n_symbols", F.col("c.lines.d").alias("n_dup_lines"), "c.n_repeat_words", (short | repeated).alias("base_failed"),
        short.alias("short"), repeated.alias("repeated"), (10 * F.col("c.n_symbols") > F.col("c.n_words")).alias("symbols"), (100 * F.col("c.lines.d") > 30 * F.col("c.lines.n")).alias("copied_lines"),
    )


def host_verdicts(rules: DataFrame, most_failing: float = MOST_FAILING) -> DataFrame:
    """host, n_docs, for each rule the shrunk rate of texts that fail it, and host_failed; one row a host that is not null.

    Rates are shrunk to a beta prior fitted to all hosts by moments: with N texts, F failures, p = F/N over k hosts of n texts and
    f failures each, rho = (sum((f - p n)^2 / n) / (p (1 - p)) - (k - 1)) / (N - sum(n^2) / N - (k - 1)), and the prior counts
    as 1 / rho - 1 texts (between LEAST_PRIOR and MOST_PRIOR; the most where hosts don't differ, or where rho is not defined).
    A host fails if for some rule the posterior mean less DEVIATIONS standard deviations is above most_failing, so a host of
    few texts is judged by what holds for hosts at large.
    """
    hosts = rules.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(f"f_{r}") for r in RULES])
    n = F.col("n_docs").cast("double")
    one = hosts.agg(
        F.count("*").alias("k"), F.sum("n_docs").alias("all"), F.sum(n * n).alias("squares"),
        *[F.sum(f"f_{r}").alias(f"all_{r}") for r in RULES], *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"parts_{r}") for r in RULES],
    )
    k, total = F.col("k") - 1, F.col("all").cast("double")

    def prior(r: str) -> list[Column]:
        p = F.col(f"all_{r}") / total
        spread = F.col(f"parts_{r}") - F.col(f"all_{r}") * p
        rho = F.try_divide(F.try_divide(spread, p * (1 - p)) - k, total - F.col("squares") / total - k)
        strength = F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(LEAST_PRIOR)), F.lit(MOST_PRIOR))).otherwise(MOST_PRIOR)
        return [p.alias(f"p_{r}"), strength.alias(f"m_{r}")]

    priors = one.select(*[c for r in RULES for c in prior(r)])

    def mean(r: str) -> Column:
        return (F.col(f"f_{r}") + F.col(f"p_{r}") * F.col(f"m_{r}")) / (n + F.col(f"m_{r}"))

    with_means = hosts.crossJoin(F.broadcast(priors)).select("host", "n_docs", *[mean(r).alias(f"{r}_rate") for r in RULES], *[f"m_{r}" for r in RULES])
    failed = F.lit(False)
    for r in RULES:
        rate = F.col(f"{r}_rate")
        failed = failed | (rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (n + F.col(f"m_{r}") + 1)) > most_failing)
    return with_means.select("host", "n_docs", *[f"{r}_rate" for r in RULES], failed.alias("host_failed"))


def domain(url: Column) -> Column:
    """The host of a URL in lower case, without www.; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, most_failing: float = MOST_FAILING) -> DataFrame:
    """The columns of `text_rules` with host_failed (see `host_verdicts`) and kept: neither base_failed nor of a host that failed.

    host is a column of docs, such as `domain(url)`; a row without host is judged by its text alone. Judged rows, without texts,
    are written once to the shared folder; rows of a hot host are not shuffled when verdicts join them. Rows repeat as in
    docs, an empty table gives none, and further columns are ignored.
    """
    rows = stage(text_rules(docs, id_col, text_col, host), "rules")
    verdicts = host_verdicts(rows, most_failing).select("host", "n_docs", "host_failed")
    with_host = join_by_key(rows.filter("host IS NOT NULL"), verdicts, ["host"], rows.count(), "n_docs").drop("n_docs")
    found = with_host.unionByName(rows.filter("host IS NULL").withColumn("host_failed", F.lit(False)))
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over all documents, a source as the host: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality_rules(only(docs, "doc_id", "text", "source"), host=F.col("source"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () r, doc_id, source, coalesce(text, '') t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ \\t\\n\\v\\f\\r]+') ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')) ls FROM d),
windows AS (SELECT r, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] k FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) p FROM w)),
repeated AS (SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
gaps AS (SELECT r, least(3, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 3)) n FROM repeated),
sums AS (SELECT r, sum(n) n FROM gaps GROUP BY r),
base AS (SELECT w.r, doc_id, source, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
                len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(sums.n, 0) n_repeat_words, len(ls) n_lines FROM w LEFT JOIN sums USING (r)),
rules AS (SELECT *, n_words < 50 short, 100 * n_repeat_words > 50 * n_words repeated, 10 * n_symbols > n_words symbols, 100 * n_dup_lines > 30 * n_lines copied FROM base),
hosts AS (SELECT source, count(*)::double n, [count(*) FILTER (short), count(*) FILTER (repeated), count(*) FILTER (symbols), count(*) FILTER (copied)] fs
          FROM rules WHERE source IS NOT NULL GROUP BY source),
by_rule AS (SELECT source, n, i, fs[i]::double f FROM hosts, generate_series(1, 4) s(i)),
sizes AS (SELECT i, count(*) - 1 k, sum(n) total, sum(n * n) squares, sum(f) / sum(n) p, sum(f * f / n) - sum(f) * sum(f) / sum(n) spread FROM by_rule GROUP BY i),
rhos AS (SELECT i, p, (spread / nullif(p * (1 - p), 0) - k) / nullif(total - squares / total - k, 0) rho FROM sizes),
priors AS (SELECT i, p, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), 10000) ELSE 10000 END m FROM rhos),
means AS (SELECT source, n, m, (f + p * m) / (n + m) rate FROM by_rule JOIN priors USING (i)),
failed AS (SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (n + m + 1)) > 0.5) host_failed FROM means GROUP BY source)
SELECT doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words,
       short OR repeated AS base_failed, NOT (short OR repeated) AND NOT coalesce(host_failed, false) AS kept
FROM rules LEFT JOIN failed USING (source)
"""
