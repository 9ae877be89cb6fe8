"""Occurrences of a dictionary of terms in texts, of any size on either side, and texts from which they are blotted out.

The dictionary is a table of forms dealt by the hash of each form's longest prefix of a stated length (1, 2, 3, 4, 6, 8, 12, 16,
24, ...). Texts stay where they are: a filter of fixed size tells at which places a prefix may begin, and only those places
leave, each with the few characters that the longest form of its length could fill. Joins by prefix find the forms, and the
characters are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .trees import cut

#: Bits of the filter of prefixes: half a megabyte, whatever the dictionary. Characters (of texts: bytes) that are hashed at once.
FILTER_BITS, CHARACTERS = 1 << 22, 1 << 18
#: Places of texts that are looked up, and handed on, at once.
PLACES = 1 << 15
#: Bits of a row of Spark's bitmap functions.
ROW_BITS = 8 * 4096
U64 = np.uint64
BASE, INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MARK = "【已隐去】"
#: A dictionary of at most so many forms and characters is broadcast.
MOST_FORMS, MOST_CHARACTERS = 100_000, 8 << 20


def prefix_lengths(longest: int) -> list[int]:
    """The lengths by which forms are dealt: two in each octave, so that a form is at most twice as long as its prefix."""
    sizes = sorted({size for k in range(longest.bit_length()) for size in (1 << k, 3 << k >> 1)})
    return [size for size in sizes if size <= longest]


def spread_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Prefixes:
    """Hashes of stretches of one sequence of characters."""

    def __init__(self, characters: np.ndarray):
        n = len(characters)
        powers = np.cumprod(np.concatenate((np.ones(1, U64), np.full(n, BASE))), dtype=U64)
        self.inverse = np.cumprod(np.concatenate((np.ones(1, U64), np.full(n, INVERSE))), dtype=U64)
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(spread_bits(characters.astype(U64) + U64(1)) * powers[:-1], dtype=U64)))

    def of(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Hashes, as signed numbers, of the `size` characters from each start."""
        return spread_bits((self.sums[starts + size] - self.sums[starts]) * self.inverse[starts] + U64(size)).view(np.int64)


def bit_of(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.int64(FILTER_BITS - 1)


class Plain:
    """Texts as searched: joined, without blanks if these are dropped, in lower case if case is folded (character by character)."""

    def __init__(self, texts: list[str], blanks: bool, fold: bool):
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t) for t in texts], np.int64)
        owner, place = np.repeat(np.arange(len(texts)), lengths), np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        kinds, inverse = np.unique(points, return_inverse=True)
        letters = [chr(p) for p in kinds.tolist()]
        if fold:
            points = np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in letters], "<u4")[inverse]
        if not blanks:
            kept = ~np.array([c.isspace() for c in letters], bool)[inverse]
            points, owner, place = points[kept], owner[kept], place[kept]
        self.points, self.owner, self.place = points, owner, place
        self.ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
        self.text = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def batches_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHARACTERS characters, or one longer text."""
    i, held = 0, 0
    for j, text in enumerate(texts):
        if j > i and held + len(text) > CHARACTERS:
            yield i, j
            i, held = j, 0
        held += len(text)
    if texts:
        yield i, len(texts)


def lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a column of texts with about CHARACTERS bytes, or one longer text."""
    i, held = 0, 0
    for j, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()):
        if j > i and held + size > CHARACTERS:
            yield i, j
            i, held = j, 0
        held += size
    if len(texts):
        yield i, len(texts)


def stretches(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.ListArray:
    """Lists of the values from starts to stops."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values[np.repeat(starts, sizes) + inside], pa.int64()))


def forms_of(terms: DataFrame, blanks: bool, fold: bool) -> DataFrame:
    """term, form (as it is searched), size and prefix (hash of so many of its first characters); empty forms and nulls are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [t or "" for t in batch.column(0).to_pylist()]
            for i, j in batches_of(names):
                part = Plain(names[i:j], blanks, fold)
                begins = np.concatenate(([0], part.ends[:-1]))
                lengths = part.ends - begins
                hashes, sizes = Prefixes(part.points), np.zeros(len(lengths), np.int64)
                prefix = np.zeros(len(lengths), np.int64)
                for size in prefix_lengths(int(lengths.max(initial=0))):
                    long = lengths >= size
                    sizes[long], prefix[long] = size, hashes.of(begins[long], size)
                rows = np.flatnonzero(lengths)
                texts = [part.text[a:b] for a, b in zip(begins[rows].tolist(), part.ends[rows].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(rows)), pa.array(texts, pa.string()), pa.array(sizes[rows]), pa.array(prefix[rows])], ["term", "form", "size", "prefix"])

    return terms.select("term").distinct().mapInArrow(run, "term string, form string, size long, prefix long")


def places(texts: DataFrame, sizes: dict[int, int], bits: bytes, blanks: bool, fold: bool, once: bool) -> DataFrame:
    """(id, size, prefix, start, window, places): where a prefix may begin, and what stands there, up to the longest form of that size."""
    kind = texts.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for i, j in lots(batch.column(1)):
                part = Plain([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()], blanks, fold)
                hashes, n = Prefixes(part.points), len(part.points)
                for size, longest in sizes.items():
                    for a in range(0, max(0, n - size + 1), PLACES):
                        starts = np.arange(a, min(a + PLACES, n - size + 1))
                        prefix = hashes.of(starts, size)
                        may = known[bit_of(prefix)] & (part.owner[starts] == part.owner[starts + size - 1])
                        starts, prefix = starts[may], prefix[may]
                        if not len(starts):
                            continue
                        stops = np.minimum(starts + longest, part.ends[part.owner[starts]])
                        windows = [part.text[x:y] for x, y in zip(starts.tolist(), stops.tolist(), strict=True)]
                        if once:
                            seen: dict[tuple[int, str], int] = {}
                            for k, key in enumerate(zip(part.owner[starts].tolist(), windows, strict=True)):
                                seen.setdefault(key, k)
                            first = list(seen.values())
                            starts, prefix, stops, windows = starts[first], prefix[first], stops[first], [windows[k] for k in first]
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).slice(i, j - i).take(pa.array(part.owner[starts])), pa.array(np.full(len(starts), size)), pa.array(prefix), pa.array(part.place[starts]),
                            pa.array(windows, pa.string()), pa.nulls(len(starts), pa.list_(pa.int64())) if blanks else stretches(part.place, starts, stops),
                        ], ["id", "size", "prefix", "start", "window", "places"])

    return texts.mapInArrow(run, f"id {kind}, size long, prefix long, start long, window string, places array<long>")


def occurrences(terms: DataFrame, texts: DataFrame, text_id: str, text: str = "text", blanks: bool = True, fold: bool = False, once: bool = False) -> DataFrame:
    """(text_id, term, start, end): every place (in characters, end excluded) where a term stands in a text; overlaps count.

    terms has a column `term`. With blanks=False blanks count neither in terms nor in texts (a span then runs from the first
    to the last character that matched); with fold=True case does not count. With once=True each term is given once a text,
    with some place. Null and empty terms and texts have no occurrence; texts that share an identifier share their rows.
    """
    known = cut(forms_of(terms, blanks, fold), "dictionary")
    bit = F.col("prefix").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    rows = known.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = bytearray(FILTER_BITS // 8)
    for r in rows:
        bits[(r["k"] - 1) * ROW_BITS // 8 : r["k"] * ROW_BITS // 8] = r["bits"]
    sizes = {r["size"]: r["longest"] for r in known.groupBy("size").agg(F.max(F.length("form")).alias("longest")).collect()}
    size = known.agg(F.count("*").alias("n"), F.sum(F.length("form")).alias("characters")).first()
    forms = F.broadcast(known) if size["n"] <= MOST_FORMS and (size["characters"] or 0) <= MOST_CHARACTERS else known
    own = texts.select(F.col(text_id).alias("id"), F.col(text).alias("text"))
    found = places(own, sizes, bytes(bits), blanks, fold, once).join(forms, ["size", "prefix"]).filter(F.startswith("window", F.col("form")))
    end = F.col("start") + F.length("form") if blanks else F.element_at("places", F.length("form")) + 1
    out = found.select(F.col("id").alias(text_id), "term", "start", end.cast("long").alias("end"))
    return out.groupBy(text_id, "term").agg(F.min_by("start", "start").alias("start"), F.min_by("end", "start").alias("end")) if once else out


def longest_first(found: DataFrame, text_id: str) -> DataFrame:
    """Of occurrences from left to right those that no occurrence begun before them, or as early and longer, covers wholly."""
    along = Window.partitionBy(text_id).orderBy("start", F.desc("end"), "term")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_reach", reach).filter(F.coalesce(F.col("_reach"), F.lit(0)) < F.col("end")).drop("_reach")


def runs(found: DataFrame, text_id: str) -> DataFrame:
    """(text_id, start, end): occurrences that overlap or touch, as one."""
    along = Window.partitionBy(text_id).orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")).over(along)
    return found.select(text_id, "start", "end", island.alias("_island")).groupBy(text_id, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def redacted(texts: DataFrame, terms: DataFrame, text_id: str, text: str = "text", mark: str = MARK) -> DataFrame:
    """texts with each run of overlapping or touching terms replaced by the mark, and n_hidden, the number of runs.

    Blanks (line breaks too) may stand inside a term, and case does not count. text_id must name one text. Texts without a
    term, and null ones, are as before. The runs of one text meet in its row; they are fewer than its characters.
    """
    spans = runs(occurrences(terms, texts, text_id, text, blanks=False, fold=True), text_id)
    lists = spans.groupBy(F.col(text_id).alias("_of")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    rows = texts.join(lists, F.col(text_id) == F.col("_of"), "left")
    hidden = F.when(F.col("_runs").isNull(), F.col(text)).otherwise(blotted(mark)(F.col(text), F.transform("_runs", lambda r: r["start"]), F.transform("_runs", lambda r: r["end"])))
    return rows.withColumns({text: hidden, "n_hidden": F.coalesce(F.size("_runs"), F.lit(0))}).drop("_of", "_runs")


def blotted(mark: str):
    """Texts with the mark in place of stretches from starts to ends."""

    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if a is None else mark.join(t[x:y] for x, y in zip([0, *b], [*a, len(t)], strict=True)) for t, a, b in zip(texts, starts, ends, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")
