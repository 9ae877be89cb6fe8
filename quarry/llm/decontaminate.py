"""Benchmark decontamination by a distributed positional inverted index.

The index is stored as a table of segments. A segment holds whole documents; its posting lists give, for each term, the
ascending positions in the segment (one position is left free between documents, so no phrase crosses two). A phrase is
looked up from its rarest term on: the posting list of that term, shifted by the term's offset, is intersected with the
shifted lists of the other terms in the order of their counts over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, LOWER, U64, bound_batches, only, scratch, slices, stage, utf8, word_hashes, words

WINDOW = 13
SEGMENT_BYTES = 1 << 20
#: Bytes of benchmark text whose windows are looked up at once, which bounds what the driver holds and broadcasts; a larger
#: benchmark takes several passes over the index.
BLOCK_BYTES = 1 << 20
#: Which terms the benchmark has is a bitmap of fixed size; a term that only shares its bit gets postings that nothing asks for.
VOCABULARY_BITS = 24

INDEX_SCHEMA = "segment long, doc_ids array<long>, begins array<int>, n_words array<int>, terms binary, starts binary, postings binary"
HITS_SCHEMA = "segment long, place int, doc_id long, n_words long, spans array<struct<item_id:bigint,start:int,end:int>>"


def term_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased in A-Z, and the text of each."""
    low = LOWER[flat]
    starts, ends, owner = words(low, offsets, ALNUM_WORD)
    return word_hashes(low, starts, ends, ALNUM_WORD), owner


def add_terms(bitmap: np.ndarray, terms: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, terms >> U64(64 - VOCABULARY_BITS + 3), np.uint8(1) << (terms >> U64(64 - VOCABULARY_BITS) & U64(7)).astype(np.uint8))


def has_terms(bitmap: np.ndarray, terms: np.ndarray) -> np.ndarray:
    return bitmap[terms >> U64(64 - VOCABULARY_BITS + 3)] >> (terms >> U64(64 - VOCABULARY_BITS) & U64(7)).astype(np.uint8) & np.uint8(1) == 1


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the positional index over whole texts; nothing is shuffled.

    With a vocabulary (a bitmap of terms) only its terms get posting lists. Null texts have no words but are listed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, number = shared.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SEGMENT_BYTES):
                hashes, owner = term_hashes(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                counts = np.bincount(owner, minlength=j - i)
                begins = np.cumsum(counts + 1) - counts - 1
                places = (np.arange(len(hashes)) + owner).astype(np.uint32)
                if vocabulary is not None:
                    known = has_terms(vocabulary, hashes)
                    hashes, places = hashes[known], places[known]
                order = np.argsort(hashes, kind="stable")
                hashes, places = hashes[order], places[order]
                starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([begins.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([counts.astype(np.int32)], pa.list_(pa.int32())), pa.array([hashes[starts].tobytes()]), pa.array([np.append(starts, len(places)).astype(np.uint32).tobytes()]), pa.array([places.tobytes()]),
                ], ["segment", "doc_ids", "begins", "n_words", "terms", "starts", "postings"])
                number += 1

    docs = only(docs, id_col, text_col)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, INDEX_SCHEMA)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences over all segments of each of the given ascending terms (those of a block of the benchmark), added up by Spark."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        if not len(wanted):
            return
        totals = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for own, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, starts = np.frombuffer(own, U64), np.frombuffer(starts, np.uint32).astype(np.int64)
                at = np.searchsorted(wanted, own)
                known = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == own)
                np.add.at(totals, at[known], np.diff(starts)[known])
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[found].view(np.int64)), pa.array(totals[found])], ["term", "n"])

    rows = index.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    totals = np.zeros(len(terms), np.int64)
    totals[np.searchsorted(terms, found["term"].to_numpy(np.int64).view(U64))] = found["n"].to_numpy(np.int64)
    shared.unpersist()
    return totals


@dataclass
class Phrases:
    """Phrases as rows of terms (numbers of the sorted distinct hashes, -1 beyond a short phrase) with the item of each."""

    terms: np.ndarray
    rows: np.ndarray
    items: np.ndarray

    @staticmethod
    def windows(hashes: np.ndarray, owner: np.ndarray, items: np.ndarray, window: int) -> Phrases:
        """All runs of `window` consecutive words of an item; an item of fewer, but not none, is one phrase."""
        terms, number = np.unique(hashes, return_inverse=True)
        counts = np.bincount(owner, minlength=len(items))
        begins = np.cumsum(counts) - counts
        rows, of = [], []
        for k in np.flatnonzero(counts):
            own = number[begins[k] : begins[k] + counts[k]]
            if len(own) < window:
                own = np.append(own, np.full(window - len(own), -1))
            views = np.lib.stride_tricks.sliding_window_view(own, window)
            rows.append(views)
            of.append(np.full(len(views), items[k]))
        if not rows:
            return Phrases(terms, np.zeros((0, window), np.int64), np.zeros(0, np.int64))
        both = np.unique(np.column_stack((np.concatenate(rows), np.concatenate(of))), axis=0)
        return Phrases(terms, both[:, :-1], both[:, -1])


def find(terms: np.ndarray, starts: np.ndarray, postings: np.ndarray, phrases: Phrases, order: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Phrase numbers and positions of their first words, for all phrases that occur in one segment.

    order has the offsets of each phrase's words, those of the rarest terms first. The shifted list of the rarest term gives
    the candidates of a phrase, and each further list is intersected with what is left of all candidates at once. slop 0 asks
    for the exact phrase; otherwise each further word may stand up to slop places from where the phrase has it.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(phrases.rows):
        return none
    at = np.minimum(np.searchsorted(terms, phrases.terms), len(terms) - 1)
    here = terms[at] == phrases.terms
    phrase = np.flatnonzero((here[phrases.rows] | (phrases.rows < 0)).all(axis=1))
    if not len(phrase):
        return none
    lengths = (phrases.rows[phrase] >= 0).sum(axis=1)
    offset = order[phrase, 0]
    term = at[phrases.rows[phrase, offset]]
    counts = starts[term + 1] - starts[term]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = postings[np.repeat(starts[term], counts) + within] - np.repeat(offset, counts)
    phrase, lengths = np.repeat(phrase, counts), np.repeat(lengths, counts)
    keys = np.repeat(np.arange(len(terms)), np.diff(starts)) << 32 | postings  # ascending: lists of ascending positions
    left = place >= 0
    for k in range(1, phrases.rows.shape[1]):
        phrase, place, lengths = phrase[left], place[left], lengths[left]
        offset = order[phrase, k]
        wanted = (at[phrases.rows[phrase, offset]] << 32) + place + offset
        low = np.searchsorted(keys, wanted - slop)
        left = (k >= lengths) | (keys[np.minimum(low, len(keys) - 1)] - wanted <= slop) & (low < len(keys))
    return phrase[left], place[left]


def look_up(index: DataFrame, phrases: Phrases, totals: np.ndarray, slop: int = 0) -> DataFrame:
    """For every document of the index: n_words and the spans of its words (first, after last) inside phrases, by item.

    A row is known by its segment and its place there, whatever its doc_id. Spans of one item that touch or overlap are one span. The phrases are a bounded block and are broadcast.
    """
    lengths = (phrases.rows >= 0).sum(axis=1)
    order = np.argsort(np.where(phrases.rows >= 0, totals[phrases.rows] if len(totals) else 0, 1 << 62), axis=1, kind="stable").astype(np.int16)
    shared = index.sparkSession.sparkContext.broadcast((phrases, order, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, order, lengths = shared.value
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for row in batch.to_pylist():
                begins, sizes = np.array(row["begins"], np.int64), np.array(row["n_words"], np.int64)
                terms, starts, postings = np.frombuffer(row["terms"], U64), np.frombuffer(row["starts"], np.uint32).astype(np.int64), np.frombuffer(row["postings"], np.uint32).astype(np.int64)
                spans: list[list] = [[] for _ in begins]
                phrase, place = find(terms, starts, postings, phrases, order, slop)
                if len(phrase):
                    item, doc = phrases.items[phrase], np.searchsorted(begins, place, side="right") - 1
                    by = np.lexsort((place, item, doc))
                    first = (place - begins[doc])[by]
                    after = np.minimum(first + lengths[phrase[by]] + slop, sizes[doc[by]])
                    for d, i, a, b in zip(doc[by].tolist(), item[by].tolist(), first.tolist(), after.tolist(), strict=True):
                        last = spans[d][-1] if spans[d] else None
                        if last and last["item_id"] == i and a <= last["end"]:
                            last["end"] = max(last["end"], b)
                        else:
                            spans[d].append({"item_id": i, "start": a, "end": b})
                own = pa.array(np.full(len(sizes), row["segment"])), pa.array(np.arange(len(sizes), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*own, pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array(spans, kind)], ["segment", "place", "doc_id", "n_words", "spans"])

    return index.mapInArrow(run, HITS_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document with n_words and spans: array of (item_id, start, end) in words, where windows of benchmark items occur.

    Words are runs of 0-9, a-z and all characters beyond ASCII, after A-Z are lower-cased. A window is `window` consecutive
    words of an item; an item of fewer, but not none, is one window. Null texts have no words; items without identifier are
    left out; rows repeat as they do in docs; further columns are ignored. Only terms of the benchmark get posting lists.
    The benchmark is taken in blocks of whole items of about block_bytes, one after another: each is looked up in the same
    stored index, its hits are written, and only then the next block comes to the driver.
    """
    spark = docs.sparkSession
    items = only(benchmark, item_col, text_col).filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))

    def block(k: int) -> Phrases:
        part = items.filter(F.col("block") == k).select("item_id", "text").toPandas().sort_values(["item_id", "text"])
        flat, offsets = utf8(pa.array(part["text"].tolist(), pa.large_string()))
        return Phrases.windows(*term_hashes(flat, offsets), part["item_id"].to_numpy(np.int64), window)

    bitmap = np.zeros(1 << (VOCABULARY_BITS - 3), np.uint8)
    for k in range(n_blocks):
        phrases = block(k)
        add_terms(bitmap, phrases.terms)
    path = scratch(spark, "postings")
    build_index(docs, bitmap, id_col, text_col).write.option("compression", "lz4").parquet(path)
    index = spark.read.parquet(path)
    if n_blocks == 1:
        return look_up(index, phrases, term_counts(index, phrases.terms), slop).drop("segment", "place")
    merged = look_up(index, Phrases(np.zeros(0, U64), np.zeros((0, window), np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int64))
    for k in range(n_blocks):
        phrases = block(k)
        hits = look_up(index, phrases, term_counts(index, phrases.terms), slop).filter(F.size("spans") > 0)
        merged = merged.unionByName(stage(hits, "hits"))
    rows = merged.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
    return rows.drop("segment", "place")


def covered(spans: Column) -> Column:
    """Words inside any of the spans (start, end), which may overlap."""
    ends = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))
    step = lambda x, s: F.struct((x["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], x["last"]))).alias("n"), F.greatest(x["last"], s["end"]).alias("last"))
    return F.aggregate(ends, begin, step, lambda x: x["n"].cast("long"))


def contamination(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words in any span), n_items, items_sha256 and contaminated, from rows with spans.

    A row without spans, of a null or empty text too, has no hits and the digest of an empty list; doc_id stays as it is, null too.
    """
    some = hits.withColumn("n_hit", F.when(F.size("spans") > 0, covered(F.col("spans"))).otherwise(F.lit(0).cast("long")))
    items = F.array_sort(F.transform(F.array_distinct(F.col("spans.item_id")), lambda i: i.cast("string")))
    return some.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over all documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (see `decontaminate`, `contamination`)."""
    return contamination(decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
