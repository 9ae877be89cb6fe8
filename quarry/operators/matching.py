"""Matching of phrases and texts by pairs of characters: overlap of points, entity matches and assignments.

Texts that contain a term are found by `dictionary.occurrences`. Phrases that are scored against
whole texts are a stated query set, compared in blocks with texts that stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import BLANKS, text_of, without_blanks
from .dictionary import occurrences
from .ranks import first_rows

# Words that carry no meaning in a point, separators, and words common to all certificates.
FILLER = "方案|措施|计划|情况|内容|的|及|与|和|等|对"
SEPARATORS = rf"[{BLANKS}、，,。．.；;：:/／()（）【】\[\]·]"
GENERIC = r"认证|证书|资质|资格|证明|有效期|复印件|的|及|与|和|等|[^\p{L}\p{N}]"
CODE_PREFIXES = ("ISO", "IEC", "GBT")
MENTIONED = 0.7


def core(text: Column) -> Column:
    """A point or text without separators and filler words."""
    # Most characters are no separator because they are letters, and begin no filler word because they are no ideographs; that is seen first.
    bare = F.regexp_replace(text_of(text), rf"(?![A-Za-z]){SEPARATORS}+", "")
    return F.regexp_replace(bare, rf"(?=[\x{{4e00}}-\x{{9fff}}])(?:{FILLER})", "")


def compact(text: Column) -> Column:
    return F.upper(without_blanks(text_of(text)))


def phrase_core(text: Column) -> Column:
    return F.regexp_replace(compact(text), GENERIC, "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, also where use refers to it in another lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring characters; none in a text of fewer than two. Linear in the text's length."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    both = F.zip_with(F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), chars, lambda b, a: F.concat(a, b))
    return F.array_distinct(F.filter(both, lambda p: p.isNotNull()))


def codes(text: Column) -> Column:
    """Standard numbers of four or five digits (no years) and acronyms, without those of standards bodies."""
    t = compact(text)
    numbers = F.filter(F.regexp_extract_all(t, F.lit(r"(?<![0-9])[0-9]{4,5}(?![0-9])"), F.lit(0)), lambda n: ~n.rlike("^(?:19|20)[0-9]{2}$"))
    acronyms = F.array_except(F.regexp_extract_all(t, F.lit("[A-Z]{3,}"), F.lit(0)), F.array(*[F.lit(p) for p in CODE_PREFIXES]))
    return F.array_distinct(F.concat(numbers, acronyms))


def contained_with_gaps(short: Column, text: Column, gap: int = 2) -> Column:
    """Whether the characters of short stand in this order in text, with at most `gap` others between two."""
    letters = F.transform(F.split(short, ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E")))
    form = F.array_join(letters, f"(?s:.){{0,{gap}}}")
    return F.regexp_like(text, form)


def forms(text: Column) -> Column:
    """What a text is searched by: without blanks, and its core."""
    return F.struct(without_blanks(text_of(text)).alias("bare"), core(text).alias("core"))


def share_in(grams: Column, text: Column) -> Column:
    return F.size(F.filter(grams, lambda g: F.contains(text, g))) / F.size(grams)


def overlap(point: Column, text: Column) -> Column:
    """How much of a point stands in a text, both given by their forms."""
    whole = (point["bare"] == "") | F.contains(text["bare"], point["bare"]) | ((F.length(point["core"]) >= 2) & F.contains(text["core"], point["core"]))
    near = (F.length(point["core"]) >= 3) & contained_with_gaps(point["core"], text["core"])
    share = let(pairs(point["core"]), lambda grams: F.when(F.size(grams) < 2, 0.0).otherwise(share_in(grams, text["core"])))
    return F.when(whole | near, 1.0).otherwise(share)


def point_overlap(point: Column, text: Column) -> Column:
    """How much of a point stands in a text: 1 if it or its core does, also with small gaps, else the share of its pairs."""
    return let(forms(text), lambda t: let(forms(point), lambda p: overlap(p, t)))


def mentioned(points: Column, text: Column) -> Column:
    """Those of an array of points that a text mentions."""
    return let(forms(text), lambda t: F.filter(points, lambda p: let(forms(p), lambda own: overlap(own, t)) >= MENTIONED))


def mentioned_in(points: Column, text: Column) -> Column:
    """Those of an array of points that a text, given by its forms, mentions."""
    return F.filter(points, lambda p: let(forms(p), lambda own: overlap(own, text)) >= MENTIONED)


def phrase_ratio(phrase: Column, text: Column) -> Column:
    def ratio(own: Column, other: Column) -> Column:
        return F.when(F.length(own) < 2, 0.0).when(F.contains(other, own), 1.0).otherwise(let(pairs(own), lambda grams: share_in(grams, other)))

    return let(compact(text), lambda other: let(phrase_core(phrase), lambda own: ratio(own, other)))


def code_ok(phrase: Column, text: Column) -> Column:
    """A phrase with codes needs one of them in the text."""
    own = codes(phrase)
    return (F.size(own) == 0) | F.arrays_overlap(own, codes(text))


#: Phrases that are held at once as a stated query set, and texts that are compared with them by one product.
PHRASES, TEXTS = 5_000, 256


def ratios(phrases: DataFrame, texts: DataFrame, phrase_id: str, text_id: str, least: float, per_phrase: int | None = None, per_text: int | None = None) -> DataFrame:
    """(phrase_id, text_id, ratio): share of each phrase's core pairs that stand in a text, where it reaches `least` (above 0).

    Phrases are a stated query set, taken in blocks; texts stay where they are and are compared with a block by presence
    vectors of its pairs. Codes of a phrase must meet those of the text. With per_phrase only the best so many texts of a
    phrase are handed on by a batch, with per_text only the best phrases of a text; ties by identifier. What is handed on holds
    the best rows of all, which `best_matches` and `assigned` cut.
    """
    asked = phrases.select(phrase_id, pairs(phrase_core(F.col("text"))).alias("pairs"), codes(F.col("text")).alias("codes")).filter(F.size("pairs") > 0)
    rows = texts.select(text_id, compact(F.col("text")).alias("text"), codes(F.col("text")).alias("codes"))
    schema = StructType([asked.schema[phrase_id], rows.schema[text_id], StructField("ratio", DoubleType())])
    n_blocks = max(1, -(-asked.count() // PHRASES))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64(phrase_id), F.lit(n_blocks)))
    found = None
    for k in range(n_blocks):
        part = asked.filter(F.col("_block") == k).drop("_block").toPandas().sort_values(phrase_id, ignore_index=True)
        more = rows.mapInArrow(presence_ratios(part, phrase_id, text_id, least, per_phrase, per_text), schema)
        found = more if found is None else found.unionByName(more)
    return found


def presence_ratios(part, phrase_id: str, text_id: str, least: float, per_phrase: int | None, per_text: int | None):
    """A function over Arrow batches (text_id, text, codes) for one block of phrases."""
    vocabulary = {p: i for i, p in enumerate(sorted({p for own in part["pairs"] for p in own}))}
    sizes = np.array([len(own) for own in part["pairs"]], np.int64)
    columns = np.array([vocabulary[p] for own in part["pairs"] for p in own], np.int64)
    begins, ids = np.cumsum(sizes) - sizes, part[phrase_id].tolist()
    coded = {k: set(own) for k, own in enumerate(part["codes"]) if len(own)}

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows if ids else 0, TEXTS):
                own = batch.slice(a, TEXTS)
                keys, texts, marks = own.column(0).to_pylist(), own.column(1).to_pylist(), own.column(2).to_pylist()
                present = np.zeros((len(texts), len(vocabulary)), np.uint8)
                for i, text in enumerate(texts):
                    present[i, [vocabulary[p] for p in set(map("".join, zip(text, text[1:], strict=False))) if p in vocabulary]] = 1
                share = np.add.reduceat(present[:, columns], begins, axis=1, dtype=np.int32) / sizes
                for k, wanted in coded.items():
                    share[[wanted.isdisjoint(m) for m in marks], k] = 0
                share[share < least] = 0
                order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i])), np.int64)
                share = share[order]
                if per_phrase is not None and per_phrase < len(keys):
                    worse = np.argsort(-share, axis=0, kind="stable")[per_phrase:]
                    np.put_along_axis(share, worse, 0, axis=0)
                if per_text is not None and per_text < len(ids):
                    worse = np.argsort(-share, axis=1, kind="stable")[:, per_text:]
                    np.put_along_axis(share, worse, 0, axis=1)
                i, k = np.nonzero(share)
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in k]), own.column(0).take(pa.array(order[i])), pa.array(share[i, k])], [phrase_id, text_id, "ratio"])

    return run


def best_matches(found: DataFrame, key: str, other: str, most: int = 8) -> DataFrame:
    """The best `most` rows of each key, ties by identifier."""
    return first_rows(found, [key], [F.desc("ratio"), F.asc(other)], most)


def assigned(found: DataFrame, point_id: str, leaf_id: str, least: float = 0.5) -> DataFrame:
    """Each point with the leaf that it is closest to, if it is close enough; the first leaf on a tie."""
    return first_rows(found.filter(F.col("ratio") >= least), [point_id], [F.desc("ratio"), F.asc(leaf_id)], 1).drop("rank")


def closest_leaf(points: DataFrame, leaves: DataFrame, least: float = 0.5) -> DataFrame:
    """(owner, point_id, leaf_id, overlap): each point with the leaf of its owner that it overlaps most, by `point_overlap`.

    points: owner, point_id, point. leaves: owner, leaf_id, pos, text. Leaves of an owner (a chapter) are few; a point of
    less than `least` everywhere has no row, and the first leaf wins a tie.
    """
    own = leaves.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("pos", "leaf_id", forms(F.col("text")).alias("form")))).alias("leaves"))  # the leaves of one chapter
    both = points.join(own, "owner").withColumn("form", forms(F.col("point")))
    scored = F.transform("leaves", lambda x: F.struct(overlap(F.col("form"), x["form"]).alias("overlap"), (-x["pos"]).alias("place"), x["leaf_id"].alias("leaf_id")))
    best = both.select("owner", "point_id", F.array_max(scored).alias("best"))
    return best.filter(F.col("best.overlap") >= least).select("owner", "point_id", F.col("best.leaf_id").alias("leaf_id"), F.round("best.overlap", 6).alias("overlap"))


def containing(terms: DataFrame, texts: DataFrame, text_id: str, parts: list[str]) -> DataFrame:
    """(text_id, term, a flag for each of the columns `parts`): terms of two characters or more that a part of a text contains.

    Texts stay where they are; see `dictionary.occurrences`. Texts that share an identifier share their rows.
    """
    asked = terms.filter(F.length("term") >= 2).select("term")
    each = texts.select(F.explode(F.array(*[F.struct(F.struct(F.col(text_id).alias("text_id"), F.lit(p).alias("part")).alias("id"), F.col(p).alias("text")) for p in parts])).alias("x"))
    found = occurrences(asked, each.select("x.id", "x.text"), "id", once=True)
    return found.groupBy(F.col("id.text_id").alias(text_id), "term").agg(*[F.bool_or(F.col("id.part") == p).alias(p) for p in parts])


def keyword_hits(keywords: DataFrame, sections: DataFrame, section_id: str) -> DataFrame:
    """(section_id, score, hits): sections that contain keywords, 3 points in the title and 1 in the body, doubled for primary keywords.

    keywords: keyword (two characters or more), primary. sections: section_id, title, body. hits are the keywords, sorted.
    """
    asked = keywords.groupBy("keyword").agg(F.bool_or("primary").alias("primary"))
    found = containing(asked.select(F.col("keyword").alias("term")), sections, section_id, ["title", "body"])
    rows = found.select(section_id, F.col("term").alias("keyword"), (3 * F.col("title").cast("int") + F.col("body").cast("int")).alias("points"))
    rows = rows.join(asked, "keyword").withColumn("points", F.col("points") * F.when(F.col("primary"), 2).otherwise(1))
    return rows.groupBy(section_id).agg(F.sum("points").alias("score"), F.array_sort(F.collect_list("keyword")).alias("hits"))


def related_sections(keywords: DataFrame, sections: DataFrame, section_id: str, most: int = 8) -> DataFrame:
    """The sections with the highest scores of `keyword_hits`; ties by identifier."""
    return keyword_hits(keywords, sections, section_id).orderBy(F.desc("score"), section_id).limit(most)
