"""Substring deduplication by compaction of a de Bruijn graph of words.

A window of k words is an edge from its first to its last k - 1 words. Only runs of windows whose minimizers occur again are
sent (see `repeats`), so edges are made of k-mers that may be repeated. Then:

1. Edges with equal minimizers meet in a bucket. There, edges that always follow one another are joined to nonbranching paths,
   and a path knows its first coordinate and the edges before and after it, which may be in other buckets.
2. Spark joins glue paths end to end where each is the other's only neighbour, and pointers are doubled along the chains until
   every path knows the head of its whole path, whose first coordinate is the source of all its edges.
3. The documents' blocks get the sources of their occurrences. Windows that follow one another, with sources that do so too,
   make long spans; the words at the source coordinates are fetched by a join and compared before a span is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_A, U64, join_by_key, mix, stage
from .repeats import RESULT_SCHEMA, Block, Spread, Windows, as_rows, bucket_of, by_bucket, chosen_runs, cuts, digests, gram_hashes, results, table

EDGE_SCHEMA = "bucket int, block long, counts binary, strings binary, number binary, ids binary, place binary, first binary, copied binary"
#: kind 0: a path with its neighbours and first coordinate; 1: occurrences of a path in a block; 2: copies of documents in a block.
GRAPH_SCHEMA = "kind int, path long, head long, tail long, pred long, succ long, length long, source_id long, source_place long, source_block long, source_unit long, block long, places binary"
SPAN_SCHEMA = "block long, source_block long, spans binary, digests binary"
#: Spans that are compared with one copy of their source block at once.
SPANS_TOGETHER = 100_000


def send_edges(plan: Windows, n_buckets: int):
    """Distinct runs of a block with the word before and after them (0 at a document's border), and all their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row, plan)
                first, count, hashes, doc, copied = chosen_runs(block, row["replies"] or [], n_buckets)
                copied, rows = copied.astype(np.uint32).tobytes(), []
                if len(first):
                    at = first[:, None] - 1 + np.arange(plan.reach + 2)
                    inside = (at >= block.offsets[doc][:, None]) & (at < np.minimum(block.offsets[doc + 1], first + count + plan.length)[:, None])
                    strings = np.where(inside, block.units[np.clip(at, 0, len(block.units) - 1)], U64(0))
                    bucket = bucket_of(hashes, n_buckets)
                    _, heads, number = np.unique(as_rows(np.column_stack((strings, count.astype(U64)))), return_index=True, return_inverse=True)
                    order = np.lexsort((number, bucket))
                    for k, s in cuts(bucket[order]):
                        own, among = np.unique(number[order[s]], return_inverse=True)
                        h, o = heads[own], order[s]
                        rows.append((k, row["block"], count[h].astype(np.uint8).tobytes(), packer.compress(strings[h].tobytes()), among.astype(np.uint32).tobytes(), block.doc_ids[doc[o]].tobytes(), (first - block.offsets[doc])[o].astype(np.uint32).tobytes(), first[o].astype(np.uint32).tobytes(), copied))
                        copied = b""
                if copied:
                    rows.append((int(row["block"]) % n_buckets, row["block"], *[b""] * 6, copied))
                if rows:
                    yield table(rows, EDGE_SCHEMA)

    return run


def edge_numbers(strings: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For every window of every string: string, offset, number of its edge (equal for equal windows, by 128 bits over 64-bit
    words) and the hashes of its own, the window before and the window after it (0 where the document begins or ends)."""
    row, offset = np.nonzero(np.arange(strings.shape[1] - length - 1) < counts[:, None])
    at = row * strings.shape[1] + offset + 1
    flat = np.append(strings.ravel(), np.zeros(length, U64))
    low, high = gram_hashes(flat, length), gram_hashes(mix(flat ^ MIX_A), length)[at]
    own = low[at]
    pred = np.where((offset > 0) | (strings[row, 0] != 0), low[at - 1], U64(0))
    after = strings[row, np.minimum(counts[row] + length, strings.shape[1] - 1)]
    succ = np.where((offset + 1 < counts[row]) | (after != 0), low[at + 1], U64(0))
    order = np.lexsort((high, own))
    new = np.concatenate(([True], (own[order][1:] != own[order][:-1]) | (high[order][1:] != high[order][:-1])))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return row, offset, number, own, pred, succ


def only_value(edge: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each edge the one value that all its occurrences have, else 0."""
    low, high = np.full(n, U64(0xFFFFFFFFFFFFFFFF)), np.zeros(n, U64)
    np.minimum.at(low, edge, value)
    np.maximum.at(high, edge, value)
    return np.where(low == high, low, U64(0))


def compacted(own: np.ndarray, pred: np.ndarray, succ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every edge (its hash and its only neighbours' hashes, 0 for none): the head of its path and the distance from it.

    An edge is joined to the one before it if each occurrence of either is beside one of the other, so all occurrences of a
    path are whole, and none is a cycle, for it would never begin.
    """
    n = len(own)
    order = np.argsort(own, kind="stable")
    at = order[np.minimum(np.searchsorted(own[order], pred), max(n - 1, 0))] if n else order
    linked = np.flatnonzero((pred != 0) & (own[at] == pred) & (succ[at] == own) & (at != np.arange(n))) if n else order
    head, distance = np.arange(n), np.zeros(n, np.int64)
    head[linked], distance[linked] = at[linked], 1
    for _ in range(64):
        further = head[head]
        if (further == head).all():
            break
        distance, head = distance + distance[head], further
    return head, distance


def resolve_edges(plan: Windows):
    """Paths of the edges that occur more than once in a bucket, and where they occur beyond their first coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = plan.reach + 2
        for bucket, rows in by_bucket(batches):
            for r in rows:
                if r["copied"]:
                    yield table([(2, *[None] * 10, r["block"], r["copied"])], GRAPH_SCHEMA)
            full = [r for r in rows if r["counts"]]
            if not full:
                continue
            counts = np.frombuffer(b"".join(r["counts"] for r in full), np.uint8).astype(np.int64)
            strings = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["strings"], max_output_size=len(r["counts"]) * width * 8) for r in full), U64).reshape(-1, width)
            ids = np.frombuffer(b"".join(r["ids"] for r in full), np.int64)
            place, first = (np.frombuffer(b"".join(r[c] for r in full), np.uint32).astype(np.int64) for c in ("place", "first"))
            block = np.repeat(np.array([r["block"] for r in full], np.int64), [len(r["ids"]) // 8 for r in full])
            base = np.concatenate(([0], np.cumsum([len(r["counts"]) for r in full])[:-1]))
            of = np.concatenate([np.frombuffer(r["number"], np.uint32).astype(np.int64) + b for r, b in zip(full, base, strict=True)])
            _, heads, same = np.unique(as_rows(np.column_stack((strings, counts.astype(U64)))), return_index=True, return_inverse=True)
            of, strings, counts = same[of], strings[heads], counts[heads]
            row, offset, edge, own, pred, succ = edge_numbers(strings, counts, plan.length)
            n = int(edge.max()) + 1
            hashes = np.zeros(n, U64)
            hashes[edge] = own
            pred, succ = only_value(edge, pred, n), only_value(edge, succ, n)
            times = np.bincount(edge, np.bincount(of, minlength=len(counts))[row], n)
            head, distance = compacted(hashes, pred, succ)
            # The first coordinate of a path is that of its head; the head's occurrences are all in strings that hold it.
            starts = np.cumsum(counts) - counts
            kept = times[head] > 1
            path = np.full(n, -1)
            some = np.flatnonzero((head == np.arange(n)) & kept)
            path[some] = np.arange(len(some))
            path = path[head]
            tail, length = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
            inner = np.flatnonzero(path >= 0)
            np.maximum.at(length, path[inner], distance[inner] + 1)
            ends = inner[distance[inner] + 1 == length[path[inner]]]
            tail[path[ends]] = ends
            # Pieces: windows of a string that follow one another on one path.
            p, d = path[edge], distance[edge]
            begin = np.concatenate(([True], (row[1:] != row[:-1]) | (p[1:] != p[:-1]) | (d[1:] != d[:-1] + 1)))
            at = np.flatnonzero(begin)
            size = np.diff(np.append(at, len(row)))
            at, size = at[p[at] >= 0], size[p[at] >= 0]
            by_string = np.argsort(of, kind="stable")
            repeats = np.bincount(of, minlength=len(counts))
            begins = np.cumsum(repeats) - repeats
            m = repeats[row[at]]
            piece = np.repeat(np.arange(len(at)), m)
            occurrence = by_string[np.repeat(begins[row[at]], m) + np.arange(len(piece)) - np.repeat(np.cumsum(m) - m, m)]
            where = offset[at][piece]
            path_of, skip, long = p[at][piece], d[at][piece], size[piece]
            unit, spot, doc_id, in_block = first[occurrence] + where, place[occurrence] + where, ids[occurrence], block[occurrence]
            atheads = np.flatnonzero(skip == 0)
            order = atheads[np.lexsort((unit[atheads], in_block[atheads], spot[atheads], doc_id[atheads], path_of[atheads]))]
            source = order[np.concatenate(([True], path_of[order][1:] != path_of[order][:-1]))] if len(order) else order
            numbers = bucket << 32
            signed = lambda x: pa.array(x.view(np.int64))
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(len(some), np.int32)), pa.array(numbers + np.arange(len(some))), signed(hashes[some]), signed(hashes[tail]), signed(pred[some]), signed(succ[tail]), pa.array(length),
                pa.array(doc_id[source]), pa.array(spot[source]), pa.array(in_block[source]), pa.array(unit[source]), none, pa.nulls(len(some), pa.binary()),
            ], [c.split()[0] for c in GRAPH_SCHEMA.split(", ")])
            other = np.flatnonzero((in_block != in_block[source][path_of]) | (unit != unit[source][path_of] + skip))
            other = other[np.lexsort((in_block[other], path_of[other]))]
            places = np.column_stack((skip, long, unit))[other].astype(np.uint32)
            key = path_of[other] * len(rows) + np.searchsorted(np.unique(in_block), in_block[other])
            lists = [(1, numbers + int(path_of[other[s.start]]), *[None] * 9, int(in_block[other[s.start]]), places[s].tobytes()) for _, s in cuts(key)]
            if lists:
                yield table(lists, GRAPH_SCHEMA)

    return run


def glued(paths: DataFrame) -> DataFrame:
    """path, source_id, source_place, source_block, source_unit and n (occurrences): the first coordinate of the head of the whole path, moved on to the path's own beginning.

    Two paths are glued if the edge after the one and the edge before the other are each other's ends. Pointers to heads are
    doubled by joins, each round written to the shared folder, so a chain of n paths takes about log2(n) rounds.
    """
    before = paths.filter("pred != 0").select("path", F.col("head").alias("to"), F.col("pred").alias("of"))
    ends = paths.filter("succ != 0").select(F.col("path").alias("root"), F.col("tail").alias("of"), F.col("succ").alias("to"), F.col("length").alias("distance"))
    links = before.join(ends, ["of", "to"]).filter("path != root").groupBy("path").agg(F.min(F.struct("root", "distance")).alias("link")).select("path", "link.*")
    chain, rounds = stage(links, "paths"), 0
    while rounds < 64:
        further = chain.select(F.col("path").alias("root"), F.col("root").alias("further"), F.col("distance").alias("more"))
        both = chain.join(further, "root", "left")
        chain = stage(both.select("path", F.coalesce("further", "root").alias("root"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance"), F.col("further").isNotNull().alias("open")), "paths")
        rounds += 1
        if chain.filter("open").isEmpty():
            break
    source = ["source_id", "source_place", "source_block", "source_unit"]
    roots = paths.join(chain.select("path").distinct(), "path", "left_anti").select("path", *source)
    step = lambda c: (F.col(c) + F.col("distance")).alias(c)
    moved = chain.join(roots.withColumnRenamed("path", "root"), "root").select("path", "source_id", step("source_place"), "source_block", step("source_unit"))
    return roots.unionByName(moved)


def words_digest(block: Block, first: int, n: int) -> bytes:
    """A digest of n words' bytes."""
    return xxhash.xxh3_128_digest(b" ".join([block.text[a:b] for a, b in zip(block.starts[first : first + n].tolist(), block.stops[first : first + n].tolist(), strict=True)]))


def find_spans(plan: Windows):
    """Long spans of a block, by the block of their source: first window, number of windows, first unit of the source, and a digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["replies"]:
                    continue
                block = Block.of(row, plan)
                source = np.full((4, len(block.starts)), -1, np.int64)
                for r in row["replies"]:
                    skip, n, unit = np.frombuffer(r["places"], np.uint32).reshape(-1, 3).astype(np.int64).T
                    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at, on = np.repeat(unit, n) + within, np.repeat(skip, n) + within
                    source[0, at], source[1, at] = r["source_id"], r["source_place"] + on
                    source[2, at], source[3, at] = r["source_block"], r["source_unit"] + on
                at = np.flatnonzero(source[2] >= 0)
                doc = np.searchsorted(block.offsets, at, side="right") - 1
                ids, place = block.doc_ids[doc], at - block.offsets[doc]
                earlier = (source[0, at] < ids) | (source[0, at] == ids) & (source[1, at] < place)
                at, doc = at[earlier], doc[earlier]
                if not len(at):
                    continue
                own = source[:, at]
                new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (own[2, 1:] != own[2, :-1]) | (own[3, 1:] != own[3, :-1] + 1)))
                heads = np.flatnonzero(new)
                spans = np.column_stack((at[heads], np.diff(np.append(heads, len(at))), own[3, heads]))
                found = [words_digest(block, int(a), int(n) + plan.length - 1) for a, n, _ in spans]
                order = np.argsort(own[2, heads], kind="stable")
                rows = [(row["block"], int(k), spans[order[s]].astype(np.uint32).tobytes(), b"".join([found[o] for o in order[s]])) for k, s in cuts(own[2, heads][order])]
                yield table(rows, SPAN_SCHEMA)

    return run


def differing(plan: Windows):
    """Spans (block, first window) whose words are not those at their source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, out, known = Block.of(row, plan), [], {}
                for r in row["replies"]:
                    for k, (first, n, unit) in enumerate(np.frombuffer(r["spans"], np.uint32).reshape(-1, 3).tolist()):
                        if (unit, n) not in known:
                            known[unit, n] = words_digest(block, unit, n + plan.length - 1)
                        if known[unit, n] != r["digests"][16 * k : 16 * k + 16]:
                            out.append((r["block"], first))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["block", "first"])

    return run


def remove_spans(plan: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row, plan)
                edges = np.zeros(len(block.starts) + plan.length + 1, np.int64)
                for r in row["replies"] or []:
                    spans = np.frombuffer(r["spans"], np.uint32).reshape(-1, r["width"]).astype(np.int64)
                    spans = spans[~np.isin(spans[:, 0], np.array(r["wrong"] or [], np.int64))]
                    np.add.at(edges, spans[:, 0], 1)
                    np.add.at(edges, spans[:, 0] + spans[:, 1] + plan.length - 1, -1)
                yield results(block, np.cumsum(edges)[: len(block.starts)] > 0)

    return run


def substring_dedup(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_units (words), spans (removed stretches of words) and kept (the other words joined by one space) for every row.

    Words are runs of other bytes than blanks (\\x20, \\x09-\\x0D). A word is removed if a window of `length` words over it also
    starts earlier: in a document with a smaller identifier or before it in the same one. Windows are judged on the input. Null
    and empty texts have no words; null identifiers come after all others; rows that share one, null too, are compared by the
    places of their windows, so copies of equal identifiers stay; further columns are ignored. Documents that are byte for byte copies of one with a smaller identifier are
    settled by a 128-bit digest; every other span is compared with the words at its source, and one that differs stays.
    """
    plan = Windows.of(length, 5, words=True, strict=False)
    spread = Spread.of(docs, plan, id_col, text_col)
    graph = stage(spread.exchange(spread.marked().mapInArrow(send_edges(plan, spread.n), EDGE_SCHEMA)).mapInArrow(resolve_edges(plan), GRAPH_SCHEMA), "graph")
    places = graph.filter("kind = 1").select("path", "block", "places")
    sources = glued(graph.filter("kind = 0")).join(places.groupBy("path").agg(F.count("*").alias("n")), "path")
    located = join_by_key(places, sources, ["path"], places.count(), "n")
    replies = spread.with_replies(located, "source_id", "source_place", "source_block", "source_unit", "places")
    spans = stage(replies.mapInArrow(find_spans(plan), SPAN_SCHEMA), "spans")
    lots = spans.groupBy("source_block").agg(F.ceil(F.sum(F.octet_length("digests") / 16) / F.lit(SPANS_TOGETHER)).alias("lots"))
    asked = spans.join(lots, "source_block").withColumn("lot", F.pmod(F.xxhash64("block"), F.col("lots")))
    asked = asked.groupBy(F.col("source_block").alias("block"), "lot").agg(F.collect_list(F.struct("block", "spans", "digests")).alias("replies"))
    wrong = stage(spread.blocks.join(asked, "block").select(*spread.blocks.columns, "replies").mapInArrow(differing(plan), "block long, first long"), "differing")
    removed = spans.select("block", "spans", F.lit(3).alias("width")).unionByName(graph.filter("kind = 2").select("block", F.col("places").alias("spans"), F.lit(2).alias("width")))
    removed = removed.join(wrong.groupBy("block").agg(F.collect_list("first").alias("wrong")), "block", "left")
    rows = spread.with_replies(removed, "spans", "width", "wrong").mapInArrow(remove_spans(plan), RESULT_SCHEMA)
    return rows.withColumn("kept", F.col("kept").cast("string"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over all documents: doc_id, n_words, n_removed, kept_sha256 (see `substring_dedup`)."""
    return digests(substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words").drop("n_spans")
