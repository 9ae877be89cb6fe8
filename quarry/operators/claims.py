"""What a section's text says by place: claims, marks to verify, clauses, assets and wording, and the report on a section.

Places are rows (section_id, start, end); which place lies in which clause, beside which mark or under which guard is told by
joins of intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lots import blanked, by_lots
from ..functions.text import CLICHES, CODE_FENCE, PLACEHOLDER, VERIFY_MARK, WEAK_PHRASES, body_chars, diagram_chars, stripped, text_of
from .commitments import excerpt, masked
from .dictionary import longest_first, occurrences
from .intervals import level_for, overlaps, sorted_join
from .matching import mentioned
from .sections import without_title
from .trees import cut

# What ends a clause and a sentence, claims about staff, words that make them plans, reach of a mark, allowances.
CLAUSE_ENDS, SENTENCE_ENDS = "[，,。；;！!？?\n]", "[。；;\n]"
STAFF_CLAIM = (
    "依法?缴纳[^，。；;\n]{0,6}社会保险|社会保险缴纳单位|社保缴纳单位|签订[^，。；;\n]{0,8}劳动合同"
    "|直接聘用|正式在职|在职员工|在职人员|自有员工|自有人员|专职员工"
)
STAFF_PLAN = "中标后|合同签订后|签订合同后|录用后|入职后|进场后|拟派|拟聘|拟投入|拟任"
MARK_REACH, LENGTH_TOLERANCE = 40, 0.3
HEADING_LINE = r"(?m)^[ \t]*#{1,6}[ \t]+\S.*$"
SPANS = "array<struct<code:string,start:long,end:long>>"
SPAN_LIST = pa.list_(pa.struct([("code", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
KEY = ["section_id"]


def spans(text: Column, forms: list[tuple[str, str]], *hidden: str) -> Column:
    """Where patterns match (code, start, end), pattern by pattern and from left to right; hidden: forms that are blanked out before."""
    seen, known = blanked(*hidden), [(code, regex.compile(form)) for code, form in forms]

    def tell(said: str | None) -> list[tuple[str, int, int]]:
        said = seen(said)
        return [(code, m.start(), m.end()) for code, form in known for m in form.finditer(said)]

    return by_lots(tell, SPANS, SPAN_LIST)(text)


@dataclass(frozen=True)
class Places:
    """What patterns match in sections: rows (section_id, kind, start, end), found in one pass over the texts and written once; top bounds intervals."""

    rows: DataFrame
    top: int

    def of(self, kind: str, start: str = "start", end: str = "end") -> DataFrame:
        return self.rows.filter(F.col("kind") == kind).select("section_id", F.col("start").alias(start), F.col("end").alias(end))

    def stretches(self, kind: str) -> DataFrame:
        """(section_id, from, to, stop): texts cut after each end mark of a kind; stop is where its mark begins, or the text's end."""
        return self.rows.filter(F.col("kind") == kind).select("section_id", F.col("start").alias("from"), F.col("end").alias("to"), "stop")


#: Kinds of places; those whose texts are cut after each match.
FORMS = {"claim": STAFF_CLAIM, "guard": STAFF_PLAN, "mark": VERIFY_MARK, "placeholder": PLACEHOLDER}
CUTS = {"clause": CLAUSE_ENDS, "sentence": SENTENCE_ENDS}


def places_in(sections: DataFrame) -> Places:
    """All places that the rules know in sections (section_id, text); null is an empty text."""
    text = text_of(F.col("text"))
    row = lambda kind, start, end, stop: F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), stop.alias("stop"))
    found = [F.transform(F.filter("_spans", lambda s: s["code"].isin(*FORMS)), lambda s: row(s["code"], s["start"], s["end"], s["end"]))]
    size = F.length("text").cast("long")
    for kind in CUTS:
        ends = F.filter("_spans", lambda s: s["code"] == kind)  # noqa: B023
        begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(ends, lambda s: s["end"]))
        stops = F.concat(ends, F.array(F.struct(F.lit(kind).alias("code"), size.alias("start"), (size + 1).alias("end"))))
        found.append(F.zip_with(begins, stops, lambda a, s: row(F.lit(kind), a, s["end"], s["start"])))  # noqa: B023
    sections = sections.select("section_id", text.alias("text"), spans(text, [*FORMS.items(), *CUTS.items()]).alias("_spans"))
    rows = cut(sections.select("section_id", F.explode(F.concat(*found)).alias("p")).select("section_id", "p.*"), "places")
    return Places(rows, level_for((rows.agg(F.max("end")).first()[0] or 0) + MARK_REACH))


def with_clauses(found: DataFrame, places: Places) -> DataFrame:
    """found (section_id, start, end, ...) with clause_start and clause_end: the clauses that it lies in, without their end marks."""
    clauses = places.stretches("clause")
    met = overlaps(found.select("section_id", "start", "end").distinct(), clauses, KEY, places.top)
    starts = met.groupBy("section_id", "start", "end").agg(F.min("from").alias("clause_start"))
    # The clause's end is looked for behind the place, whose own characters may be end marks.
    behind = overlaps(found.select("section_id", F.col("end").alias("start"), (F.col("end") + 1).alias("end")).distinct(), clauses, KEY, places.top)
    stops = behind.groupBy("section_id", F.col("start").alias("end")).agg(F.min("stop").alias("clause_end"))
    return sorted_join(sorted_join(found, starts, ["section_id", "start", "end"]), stops, ["section_id", "end"])


def marked(found: DataFrame, places: Places) -> DataFrame:
    """found (section_id, start, end, ..., clause_end) with marked: inside a mark to verify, or followed by one.

    A mark follows if it stands whole before the sentence ends and ends at most MARK_REACH characters after the clause.
    """
    marks = places.of("mark", "from", "to")
    own = found.select("section_id", "start", "end", "clause_end").distinct()
    inside = overlaps(own, marks, KEY, places.top).filter("`from` <= start AND `end` <= `to`").select("section_id", "start", "end")
    points = own.select("section_id", F.col("start").alias("_start"), "clause_end", F.col("end").alias("start"), (F.col("end") + 1).alias("end"))
    reach = overlaps(points, places.stretches("sentence"), KEY, places.top).select("section_id", "_start", F.col("start").alias("_end"), "start", F.least(F.col("clause_end") + MARK_REACH, F.col("stop")).alias("end"))
    behind = overlaps(reach, marks, KEY, places.top).filter("start <= `from` AND `to` <= `end`").select("section_id", F.col("_start").alias("start"), F.col("_end").alias("end"))
    hit = inside.unionByName(behind).distinct().withColumn("marked", F.lit(True))
    return sorted_join(found, hit, ["section_id", "start", "end"], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))


def first_of_clause(claims: DataFrame) -> DataFrame:
    """From left to right, claims whose clause shares no place with that of the claim taken last; the claims of a section are folded in its row."""
    rows = claims.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "clause_start", "clause_end"))).alias("_all"))
    none = F.slice("_all", 1, 0)

    def take(kept: Column, claim: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) > 0) & (claim["clause_start"] < last["clause_end"]) & (claim["clause_end"] > last["clause_start"]), kept).otherwise(F.concat(kept, F.array(claim)))

    return rows.select("section_id", F.explode(F.aggregate("_all", none, take)).alias("_c")).select("section_id", "_c.*")


def staff_claims(sections: DataFrame, places: Places | None = None) -> DataFrame:
    """(section_id, start, end): claims about the staff as it is (section_id, text), one a clause, without marked ones and plans.

    What the report does with them depends on whether any data on staff are there.
    """
    places = places or places_in(sections)
    placed = marked(with_clauses(places.of("claim"), places), places).filter(~F.col("marked"))
    clauses = placed.select("section_id", F.col("clause_start").alias("start"), F.col("clause_end").alias("end")).distinct()
    planned = overlaps(clauses, places.of("guard", "from", "to"), KEY, places.top).filter("start <= `from` AND `to` <= `end`").select("section_id", F.col("start").alias("clause_start"), F.col("end").alias("clause_end")).distinct()
    return first_of_clause(sorted_join(placed, planned, ["section_id", "clause_start", "clause_end"], "left_anti")).select("section_id", "start", "end")


def asset_mentions(sections: DataFrame, assets: DataFrame, places: Places | None = None) -> DataFrame:
    """(section_id, start, end, asset_id, code): assets (asset_id, identifier, status) in texts, blanks aside.

    Only examples and unverified assets are looked for, by identifiers of two characters or more; an example whose identifier a usable asset has
    is left out. code: example_asset, unmarked_unverified, or to_verify for an unverified one that is marked. Of mentions of
    one asset inside each other the outer one counts.
    """
    bare = F.regexp_replace(text_of(F.col("identifier")), r"\s+", "")
    own = assets.select("asset_id", bare.alias("term"), "status").filter(F.length("term") >= 2)
    shared = own.filter("status != 'example'").select("term").distinct().withColumn("_usable", F.lit(True))
    asked = own.filter("status IN ('example', 'unverified')").join(shared, "term", "left").filter("NOT (status = 'example' AND _usable IS NOT NULL)").drop("_usable").distinct()
    found = occurrences(asked.select("term"), sections, "section_id", blanks=False).join(asked, "term")
    outer = longest_first(found.withColumn("_of", F.struct("section_id", "asset_id")), "_of").drop("_of").dropDuplicates(["section_id", "asset_id", "start", "end"])
    places = places or places_in(sections)
    placed = marked(with_clauses(cut(outer, "mentions"), places), places)
    code = F.when(F.col("status") == "example", "example_asset").when(F.col("marked"), "to_verify").otherwise("unmarked_unverified")
    return placed.select("section_id", "start", "end", "asset_id", code.alias("code"))


def wording(sections: DataFrame) -> DataFrame:
    """(section_id, start, end, code): headings by markup, empty phrases and weak phrases in texts; code fences aside."""
    forms = [("markdown_heading", HEADING_LINE), *[("cliche", p) for p in CLICHES], *[("weak_phrase", regex.escape(p)) for p in WEAK_PHRASES]]
    return sections.select("section_id", F.explode(spans(F.col("text"), forms, CODE_FENCE)).alias("x")).select("section_id", "x.start", "x.end", "x.code")


def measures(sections: DataFrame) -> DataFrame:
    """(section_id, code): texts off their word budget by more than LENGTH_TOLERANCE, diagrams over theirs, and titles repeated.

    sections: section_id, text, title, budget, diagram_budget; a budget that is null or 0 is none.
    """
    text, said = F.col("text"), text_of(F.col("text"))
    codes = F.array(
        F.when((F.col("budget") > 0) & (F.abs(body_chars(text) / F.col("budget") - 1) > LENGTH_TOLERANCE), "length"),
        F.when((F.col("diagram_budget") > 0) & (diagram_chars(text) > F.col("diagram_budget")), "diagram_length"),
        F.when(without_title(text, F.col("title")) != said, "title_repeat"),
    )
    return sections.select("section_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def missing_points(sections: DataFrame, points: DataFrame) -> DataFrame:
    """(section_id, point): points (section_id, point) that neither the section's title nor its text mentions; a section's points are tested in its row."""
    own = points.groupBy("section_id").agg(F.collect_set("point").alias("points"))
    rows = sorted_join(sections.select("section_id", F.concat_ws("\n", F.col("title"), text_of(F.col("text"))).alias("said")), own, "section_id")
    return rows.select("section_id", F.explode(F.array_except("points", mentioned(F.col("points"), F.col("said")))).alias("point"))


def placeholders(sections: DataFrame, places: Places | None = None) -> DataFrame:
    """(section_id, start, end, item): marks still to be filled in; equal ones are one item, the two that say nothing one by clause."""
    body = sections.select("section_id", masked(F.col("text"), CODE_FENCE).alias("text"))
    places = places or places_in(body)
    placed = sorted_join(with_clauses(places.of("placeholder"), places), body, "section_id")
    own = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    clause = F.trim(F.substring("text", (F.col("clause_start") + 1).cast("int"), (F.col("clause_end") - F.col("clause_start")).cast("int")))
    return placed.select("section_id", "start", "end", F.when(own.isin("【待填写】", "【待核实】"), clause).otherwise(own).alias("item"))


def section_issues(sections: DataFrame, assets: DataFrame, points: DataFrame, commitments: DataFrame | None = None) -> DataFrame:
    """(section_id, level, code, start, excerpt, line): all that the rules find in sections (section_id, title, text, budget, diagram_budget).

    level: blocking, quality or verify. assets: asset_id, identifier, status, kind; claims about staff are held against no one
    who has staff that is no example. commitments: issues of `commitments.check_commitments`. An empty text has one issue, `empty`.
    """
    sections = cut(sections, "sections")
    written = sections.filter(stripped(text_of(F.col("text"))) != "")
    bare = cut(written.withColumn("text", masked(F.col("text"), CODE_FENCE)), "bare")
    places = places_in(bare)
    staff = assets.filter("kind = 'personnel' AND status != 'example'").limit(1).select(F.lit(True).alias("_staff"))  # one row at most
    row = lambda df, level, code, start="start", end="end": df.select("section_id", F.lit(level).alias("level") if isinstance(level, str) else level.alias("level"), (F.lit(code) if isinstance(code, str) else code).alias("code"), *[(F.col(c) if c else F.lit(None)).cast("long").alias(n) for c, n in ((start, "start"), (end, "end"))])
    claims = staff_claims(bare, places).join(F.broadcast(staff), F.lit(True), "left_anti")
    code = F.col("code")
    parts = [
        row(sorted_join(sections, written.select("section_id"), "section_id", "left_anti"), "blocking", "empty", None, None),
        row(claims, "blocking", "employment_claim"), row(asset_mentions(bare, assets, places), F.when(code == "to_verify", "verify").otherwise("blocking"), code),
        row(wording(written), "quality", code), row(measures(written), "quality", code, None, None), row(missing_points(bare, points), "blocking", "missing_point", None, None),
        row(placeholders(written, places), "verify", "placeholder"),
    ]
    if commitments is not None:
        parts.append(row(sorted_join(commitments, written.select("section_id"), "section_id", "left_semi"), F.col("level"), code, "start", None))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    at = F.when(F.col("end").isNotNull(), excerpt(text_of(F.col("text")), F.col("start").cast("int"), F.col("end").cast("int")))
    return sorted_join(found, sections.select("section_id", "text"), "section_id").select("section_id", "level", "code", "start", at["text"].alias("excerpt"), at["line"].alias("line"))


def report(sections: DataFrame, issues: DataFrame) -> DataFrame:
    """section_id, chars, blocking, quality, verify, passed and the three codes met most, for every section."""
    by_code = issues.groupBy("section_id", "level", "code").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("section_id").orderBy(F.desc("n"), "code", "level"))
    count = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, F.col("n"))), F.lit(0)).alias(level)
    most = F.transform(F.array_sort(F.collect_list(F.when(F.col("_place") <= 3, F.struct("_place", "code")))), lambda x: x["code"]).alias("codes")
    sums = by_code.withColumn("_place", place).groupBy("section_id").agg(count("blocking"), count("quality"), count("verify"), most)
    none = F.array().cast("array<string>")
    rows = sorted_join(sections.select("section_id", body_chars(F.col("text")).alias("chars")), sums, "section_id", "left")
    return rows.select("section_id", "chars", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blocking", "quality", "verify")], (F.coalesce("blocking", F.lit(0)) == 0).alias("passed"), F.coalesce("codes", none).alias("codes"))
