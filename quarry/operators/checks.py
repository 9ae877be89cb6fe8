"""Rule checks: material, quality, keyword scans, commitments against facts, preflight and revision policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import bands, parse_date, same_value
from ..functions.text import BLANKS, placeholders, text_of
from .matching import containing

# Codes of material problems, the status that each leads to, and statuses from the worst on.
PROBLEM_STATUS = {
    "example": "example", "expired": "expired", "expiring": "expired", "holder_mismatch": "wrong holder", "no_attachment": "no attachment",
    "unverified": "to verify", "expiry_unknown": "to verify",
}
STATUS_ORDER = ["example", "expired", "wrong holder", "broken link", "no attachment", "to verify"]
BLOCKING = ("expired", "expiring", "holder_mismatch")
NO_EXPIRY = "长期|永久|无固定期限"


def bare_name(name: Column) -> Column:
    return F.regexp_replace(text_of(name), rf"[{BLANKS}()（）【】\[\]·•,，.。]", "")


def material_problems(kind: Column, status: Column, attachments: Column, expiry: Column, holder: Column, company: Column, today: Column, deadline: Column) -> Column:
    """Codes of what keeps an asset from being proof, in the order of the checks."""
    text = F.trim(text_of(expiry))
    day = parse_date(text, month_end=True)
    dated = (kind == "qualifications") & (text != "") & ~text.rlike(NO_EXPIRY)
    own, other = F.trim(text_of(holder)), F.trim(text_of(company))
    codes = [
        F.when(status == "example", "example").when(status == "unverified", "unverified"),
        F.when(F.coalesce(attachments, F.lit(0)) == 0, "no_attachment"),
        F.when(dated & day.isNull(), "expiry_unknown").when(dated & (day < today), "expired").when(dated & (day < deadline), "expiring"),
        F.when((own != "") & (other != "") & (bare_name(own) != bare_name(other)), "holder_mismatch"),
    ]
    return F.filter(F.array(*codes), lambda c: c.isNotNull())


def worst_of(problems: Column) -> Column:
    """The worst status that problem codes lead to; complete without problems."""
    statuses = F.transform(problems, lambda c: F.element_at(F.create_map(*[F.lit(x) for k, v in PROBLEM_STATUS.items() for x in (k, v)]), c))
    return reduce(lambda rest, s: F.when(F.array_contains(statuses, s), s).otherwise(rest), reversed(STATUS_ORDER), F.lit("complete"))


def blocking(problems: Column) -> Column:
    return F.arrays_overlap(problems, F.array(*[F.lit(c) for c in BLOCKING]))


def quality_dimensions(sections: DataFrame, *keys: str) -> DataFrame:
    """Scores of eight dimensions by group, from indicator columns of sections, with their mean and rating.

    A dimension's score is 100 times the share of written sections whose indicator holds; without written sections it is
    null and does not count in the mean.
    """
    names = ["complete", "consistent", "structured", "plain", "concrete", "illustrated", "aligned", "formal"]
    scores = [F.bround(100 * F.avg(F.when(F.col("written"), F.col(n).cast("int"))), 0).cast("int").alias(n) for n in names]
    rows = sections.groupBy(*keys).agg(*scores, F.count("*").alias("sections"))
    known = F.filter(F.array(*[F.col(n).cast("double") for n in names]), lambda s: s.isNotNull())
    total = F.when(F.size(known) > 0, F.bround(F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known), 0).cast("int"))
    return rows.withColumn("total", total).withColumn("rating", bands(F.col("total")))


# What a clause is scanned for, marks that are no part of it, and words that say nothing.
SCAN_TERM, CLAUSE_MARKS = "[\\x{4e00}-\\x{9fa5}A-Za-z0-9]{3,}", "[★▲]"
SCAN_STOP = ("投标人", "所投系统", "必须", "应当", "本项目")
WRITTEN_CHARS = 20


def keyword_scan(clauses: DataFrame, texts: DataFrame, clause_id: str, group: str) -> DataFrame:
    """(group, clause_id, hits, covered): terms of each clause that the group's texts contain; covered by two, or one of five characters.

    clauses: group, clause_id, clause. texts: group, text_id, text; texts of at most 20 characters do not count. Terms are runs
    of three or more letters, digits and ideographs; a term that a clause repeats counts as often.
    """
    terms = F.filter(F.regexp_extract_all(F.regexp_replace(F.coalesce("clause", F.lit("")), CLAUSE_MARKS, ""), F.lit(SCAN_TERM), F.lit(0)), lambda t: ~t.isin(*SCAN_STOP))
    each = clauses.select(group, clause_id, terms.alias("terms"))
    asked = each.select(group, clause_id, F.explode("terms").alias("term"))
    written = texts.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > WRITTEN_CHARS)
    found = containing(asked.select("term").distinct(), written.select("text_id", "text"), "text_id", ["text"])
    held = found.select("text_id", "term").join(written.select("text_id", group), "text_id").select(group, "term").distinct()
    hits = asked.join(held, [group, "term"]).groupBy(group, clause_id).agg(F.count("*").alias("hits"), F.max(F.length("term")).alias("longest"))
    rows = clauses.select(group, clause_id).join(hits, [group, clause_id], "left")
    return rows.select(group, clause_id, F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce((F.col("hits") >= 2) | (F.col("longest") >= 5), F.lit(False)).alias("covered"))


LARGER_IS_BETTER = ("warranty", "staff", "inspection", "window")


def commitment_relations(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claims with relation to the facts of their topic (of all topics where it is null) and scope.

    Both have topic, scope, dimension, number, value, approx and comparator; scope stands for grade, place and subject together.
    scope_unknown: facts, but none in this scope; conflict: opposite bounds; backed: an equal fact; unbacked: no fact, or no
    topic; stronger: at least as good as one; incomparable: one of another dimension; else conflict. The distinct facts of a
    topic and scope are one row, so a claim never becomes more than one.
    """
    fact = F.struct("topic", "dimension", "number", "value", "approx", "comparator")
    each = facts.select("scope", fact.alias("fact"), F.explode(F.array(F.coalesce("topic", F.lit("")), F.lit(""))).alias("_topic"))
    own = each.groupBy("_topic", "scope").agg(F.collect_set("fact").alias("_facts"))
    known = own.select("_topic").distinct().withColumn("_known", F.lit(True))
    rows = claims.withColumn("_topic", F.coalesce("topic", F.lit(""))).join(known, "_topic", "left").join(own, ["_topic", "scope"], "left")
    some = lambda test: F.coalesce(F.exists("_facts", test), F.lit(False))
    comparable = lambda f: f["dimension"] == F.col("dimension")
    better = lambda f: F.when(f["topic"].isin(*LARGER_IS_BETTER), F.col("number") >= f["number"]).otherwise(F.col("number") <= f["number"])
    bound = lambda c: c.isin("le", "ge")
    opposite = some(lambda f: bound(F.col("comparator")) & bound(f["comparator"]) & (F.col("comparator") != f["comparator"]))
    mine = F.struct("dimension", "number", "value", "approx")
    relation = (
        F.when(F.col("_known") & F.col("_facts").isNull(), "scope_unknown").when(opposite, "conflict").when(some(lambda f: same_value(mine, f)), "backed")
        .when(F.col("_facts").isNull() | (F.col("_topic") == ""), "unbacked").when(some(lambda f: comparable(f) & better(f)), "stronger").when(some(lambda f: ~comparable(f)), "incomparable").otherwise("conflict")
    )
    return rows.select(*claims.columns, relation.alias("relation"))


def preflight(checks: dict[str, DataFrame], most_details: int = 50) -> DataFrame:
    """One row a check: code, attention (rows found), ok and up to most_details details, from tables with a column detail."""
    rows = [t.agg(F.count("*").alias("attention"), F.slice(F.array_sort(F.collect_set(F.when(F.col("_rank") <= most_details, F.col("detail")))), 1, most_details).alias("details")).withColumn("code", F.lit(code)) for code, t in ((c, ranked_details(d, most_details)) for c, d in checks.items())]
    return reduce(DataFrame.unionByName, rows).withColumn("ok", F.col("attention") == 0)


def ranked_details(rows: DataFrame, most: int) -> DataFrame:
    """detail and _rank: the first `most` details in order have ranks, all others null; only those few are ordered."""
    first = rows.select("detail").distinct().orderBy("detail").limit(most).withColumn("_rank", F.lit(1))
    return rows.select("detail").join(F.broadcast(first), "detail", "left")


def revision_policy(reports: DataFrame, threshold: int = 2, max_rounds: int = 2) -> DataFrame:
    """One row a section: the next action after its reports (section_id, round, blocking, quality, chars, budget).

    A round is progress if blocking issues fall; or with none left, quality issues; or if neither grows and the length comes
    nearer to the budget. Reports that lose nothing and meet the threshold are accepted; after two rounds in a row without
    progress only blocking issues matter; used-up rounds stop.
    """
    order = Window.partitionBy("section_id").orderBy("round")
    distance = F.when(F.col("budget") > 0, F.abs(F.col("chars") / F.col("budget") - 1)).otherwise(0.0)
    rows = reports.withColumn("distance", distance)
    was = lambda c: F.lag(c).over(order)
    fewer = F.col("blocking") < was("blocking")
    cleaner = (was("blocking") == 0) & (F.col("blocking") == 0) & (F.col("quality") < was("quality"))
    nearer = (F.col("blocking") <= was("blocking")) & (F.col("quality") <= was("quality")) & (F.col("distance") < was("distance"))
    rows = rows.withColumn("progress", F.when(was("round").isNull(), True).otherwise((F.col("blocking") <= was("blocking")) & (fewer | cleaner | nearer)))
    island = rows.withColumn("island", F.sum(F.col("progress").cast("int")).over(order))
    streaks = island.withColumn("streak", F.sum((~F.col("progress")).cast("int")).over(Window.partitionBy("section_id", "island").orderBy("round")))
    last = streaks.groupBy("section_id").agg(
        F.max_by(F.struct("blocking", "quality", "distance", "chars", "budget", "streak"), "round").alias("l"), F.max("streak").alias("longest"), (F.count("*") - 1).alias("rounds")
    )
    b, q = F.col("l.blocking"), F.col("l.quality")
    minimal = F.col("longest") >= 2
    met = (b == 0) & (q <= threshold) & (F.col("l.distance") <= 0.3)
    kind = F.when(met | (minimal & (b == 0)), "accept").when(F.col("rounds") >= max_rounds, "stop").otherwise("revise")
    over = (b == 0) & (F.col("l.budget") > 0) & (F.col("l.chars") / F.col("l.budget") - 1 > 0.3)
    mode = F.when(kind == "revise", F.when(over, "compress").when(minimal, "minimal").when(F.col("l.streak") == 1, "alternate").otherwise("normal"))
    reason = F.when(met, "goal_met").when(kind == "accept", "no_improvement").when(kind == "stop", F.when(F.col("l.streak") > 0, "no_improvement").otherwise("rounds_exhausted"))
    return last.select("section_id", kind.alias("kind"), mode.alias("mode"), reason.alias("reason"), F.col("l.streak").alias("trailing"), "longest")


def unwritten(nodes: DataFrame) -> DataFrame:
    """Nodes without content."""
    return nodes.filter(F.trim(text_of(F.col("content"))) == "")


def with_placeholders(nodes: DataFrame) -> DataFrame:
    """Nodes whose content has marks that are to be filled in or verified, with their number and the first three."""
    found = placeholders(F.col("content"))
    return nodes.withColumn("placeholders", F.size(found)).withColumn("samples", F.slice(F.array_distinct(found), 1, 3)).filter("placeholders > 0")


def unreviewed(nodes: DataFrame) -> DataFrame:
    """Written nodes that are not reviewed, or were revised since."""
    return nodes.filter((F.trim(text_of(F.col("content"))) != "") & ~((F.col("status") == "reviewed") & F.col("reviewed_revision").eqNullSafe(F.col("revision"))))


def redline_state(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """project_id, state by the last run (project_id, checked_at, run_id, status, risks): attention if it found risks, ok if not,
    unknown where there is none, it did not complete, or it found none and the project has changed since."""
    last = runs.groupBy("project_id").agg(F.max_by(F.struct("checked_at", "status", "risks"), F.struct("checked_at", "run_id")).alias("last"))
    rows = projects.join(last, "project_id", "left")
    sure = F.coalesce(F.col("last.status") == "completed", F.lit(False))
    state = F.when(~sure, "unknown").when(F.col("last.risks") > 0, "attention").when(F.col("updated_at") > F.col("last.checked_at"), "unknown").otherwise("ok")
    return rows.select("project_id", state.alias("state"))
