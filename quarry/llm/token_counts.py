"""Token counts of sections: documents are encoded once, and token spans are joined to section spans."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, only, slices, utf8
from .tokenize import SpanEncoder, kept, spread, vocabulary_path


def line_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of texts, each with its line feed: text, number in it, and span in characters. An empty text is one empty line."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    feeds = np.flatnonzero(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") == 10)
    owner = np.searchsorted(ends, feeds, side="right")
    inside = feeds + 1 < ends[owner]
    starts = np.concatenate((ends - lengths, feeds[inside] + 1))
    text = np.concatenate((np.arange(len(texts)), owner[inside]))
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    first = np.searchsorted(text, np.arange(len(texts)))
    stops = np.where(np.append(text[1:], -1) == text, np.append(starts[1:], 0), ends[text])
    base = (ends - lengths)[text]
    return text, np.arange(len(text)) - first[text], np.stack((starts - base, stops - base), axis=1)


def stretches(sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the owner of characters changes, and the section (row) that owns them from there on, -1 for none.

    Sections are sorted by start; of those that cover a character the last one owns it. Those without length own nothing.
    """
    rows = np.flatnonzero(sections[:, 0] < sections[:, 1])
    if not len(rows):
        return rows, rows
    starts, ends = sections[rows, 0], sections[rows, 1]
    if (starts[1:] >= ends[:-1]).all():
        places, owners = np.stack((starts, ends), axis=1).ravel(), np.stack((rows, np.full(len(rows), -1)), axis=1).ravel()
        real = np.append(places[:-1] < places[1:], True)
        return places[real], owners[real]
    places, owners, open_, k = np.unique(np.concatenate((starts, ends))), [], [], 0
    for place in places.tolist():
        while k < len(rows) and starts[k] == place:
            heapq.heappush(open_, (-int(rows[k]), int(ends[k])))
            k += 1
        while open_ and open_[0][1] <= place:
            heapq.heappop(open_)
        owners.append(-open_[0][0] if open_ else -1)
    return places, np.array(owners, np.int64)


def attribute(tokens: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """For each token span the row of the section it is counted in, or -1.

    A token counts where most of its characters lie, in the earliest such section on a tie; a token that touches no section
    counts in none. Sections are sorted by start; a character in several sections (nested, equal or overlapping) belongs to
    the one that starts last, the later row of equal starts.
    """
    places, owners = stretches(sections)
    owners, stops = np.append(owners, -1), np.append(places, np.iinfo(np.int64).max)
    first = np.searchsorted(places, tokens[:, 0], side="right") - 1
    last = np.searchsorted(places, np.maximum(tokens[:, 1] - 1, tokens[:, 0]), side="right") - 1
    out = owners[first]
    border = np.flatnonzero(first != last)
    if not len(border):
        return out
    n = last[border] - first[border] + 1
    token, at = np.repeat(border, n), spread(first[border], n)
    shared = np.minimum(tokens[token, 1], stops[at + 1]) - np.where(at < 0, tokens[token, 1], np.maximum(tokens[token, 0], stops[at]))
    owned = (owners[at] >= 0) & (shared > 0)
    pairs, inverse = np.unique(np.stack((token[owned], owners[at][owned]), axis=1), axis=0, return_inverse=True)
    total = np.bincount(inverse.ravel(), shared[owned], len(pairs))
    order = np.lexsort((pairs[:, 1], -total, pairs[:, 0]))
    best = order[np.append(True, np.diff(pairs[order, 0]) > 0)[: len(order)]]
    out[border] = -1
    out[pairs[best, 0]] = pairs[best, 1]
    return out


def count_tokens(encoder: SpanEncoder, texts: list[str], given: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Text of each row, and rows of section, start, end and number of tokens, for texts together.

    given: for each section its text (ascending), its number, and its span; else sections are the lines.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(lengths) - lengths
    text, number, spans = line_spans(texts) if given is None else given
    tokens, per_text = encoder.spans(texts)
    owner = attribute(tokens, np.clip(spans, 0, lengths[text][:, None]) + base[text][:, None])
    counts = np.bincount(owner + 1, minlength=len(text) + 1)[1:]
    outside = np.bincount(np.repeat(np.arange(len(texts)), per_text)[owner < 0], minlength=len(texts))
    more = np.flatnonzero((outside > 0) | (np.bincount(text, minlength=len(texts)) == 0))
    rows = np.concatenate((np.column_stack((number, spans, counts)), np.column_stack((np.full(len(more), -1), np.zeros(len(more), np.int64), lengths[more], outside[more]))))
    return np.concatenate((text, more)), rows


def token_counts(docs: DataFrame, tokenizer: str, sections: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, section, start, end, n_tokens: tokens of every whole text counted by section, by the rule of `attribute`.

    sections has columns of the names of id_col, section (int), start and end (characters); without it the lines of a text
    are its sections, numbered from 0. Tokens outside all sections are counted in a row with section -1 (if there are any).
    The counts of a document's rows add up to its tokens. Null texts are empty; a document without sections or text has one
    row with no tokens. Rows repeat as they do in docs; null bounds or sections are ignored; further columns are ignored.
    """
    docs = only(docs, id_col, text_col)
    bound_batches(docs.sparkSession)
    if sections is not None:
        key = docs.columns[0]
        spans = only(sections, id_col, "section", "start", "end").filter("section IS NOT NULL AND start IS NOT NULL AND `end` IS NOT NULL")
        spans = spans.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long"), F.col("end").cast("long"), F.col("section").cast("int")))).alias("spans"))
        docs = docs.join(spans, key, "left").select(key, text_col, "spans")
    given = sections is not None
    kind = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(SpanEncoder, tokenizer)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 2 << 20):
                texts, sections = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()], None
                if given:
                    lists = batch.column(2).slice(i, j - i)
                    per_text, flat = lists.value_lengths().fill_null(0).to_numpy(), lists.flatten()
                    start, end, number = (flat.field(k).to_numpy() for k in range(3))
                    sections = np.repeat(np.arange(len(texts)), per_text), number, np.stack((start, end), axis=1)
                rows, values = count_tokens(encoder, texts, sections)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i).take(pa.array(rows)), pa.array(values[:, 0].astype(np.int32)), pa.array(values[:, 1]), pa.array(values[:, 2]), pa.array(values[:, 3]),
                ], ["doc_id", "section", "start", "end", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {kind}, section int, start long, end long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over all documents, by line: doc_id, section, start, end, n_tokens (see `token_counts`)."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("byte_bpe_50k.json"))
