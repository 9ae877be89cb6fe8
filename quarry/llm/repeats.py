"""Windows that occur more than once over all documents, found in two exchanges of compact arrays.

A window is a run of `length` units (words or bytes) of one document. Each window belongs to the least-hashed of its grams
(its minimizer), and the windows of one document that share a minimizer's place form a run. Equal windows have equal
minimizers, so it is enough to bring runs with equal minimizers together:

1. every block of documents sends the distinct minimizers of its runs; those met twice come back marked;
2. blocks send the distinct unit strings of marked runs with their first occurrence; a resolver finds, for every window of
   every string, where it occurs first, and blocks get back which windows occur earlier elsewhere.

Equal strings of a block are sent once, so a string that fills a third of the corpus moves as one entry a block. Documents
that are byte-for-byte copies of one with a smaller identifier are settled by a digest in the first exchange. Entries travel
as arrays of one (bucket, block) pair each; the number of buckets follows the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, U64, buckets, mix, only, scratch, slices, utf8, word_hashes, words

BLOCK_BYTES = 2 << 20
#: Text for which one bucket of each exchange is made.
BUCKET_BYTES = 16 << 20
#: Null identifiers come after all others, with the last one; which rows have none is kept beside.
LAST_ID = (1 << 63) - 1
PLACE = U64((1 << 23) - 1)
#: A minimizer in more blocks than this (8 GB of text) is split by its windows, which take more room than its runs.
HOT_BLOCKS = 4096
#: Grams that are hashed at once, so that they stay near the processor; entries of one answer to Spark.
STRETCH, ENTRIES = 1 << 16, 1 << 8
#: Windows of a run at most: which of them repeat is one mask.
MASK_BITS = 64


@dataclass(frozen=True)
class Windows:
    """length: units of a window; gram: units of a minimizer; strict: only windows of smaller identifiers count as earlier."""

    length: int
    gram: int
    words: bool
    strict: bool

    def __post_init__(self):
        if self.most > MASK_BITS:
            raise ValueError(f"{self.most} windows of a run do not fit in {MASK_BITS} bits: grams of {self.gram} are too short for windows of {self.length}")

    @staticmethod
    def of(length: int, gram: int, words: bool, strict: bool) -> Windows:
        """Grams of so many units, or of more where windows are so long that a run would not fit in its mask."""
        return Windows(length, max(1, min(gram, length // 2), length - MASK_BITS + 1), words, strict)

    @property
    def most(self) -> int:
        """Windows of a run at most."""
        return self.length - self.gram + 1

    @property
    def reach(self) -> int:
        """Units of a run's string at most."""
        return self.length + self.most - 1


def to_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows block, doc_ids, missing (bits: no identifier), ends, text: whole documents, some BLOCK_BYTES together, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, packer = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            ids, missing = batch.column(0).fill_null(LAST_ID).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, BLOCK_BYTES):
                text = flat[offsets[i] : offsets[j]]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids[i:j].tobytes()]), pa.array([np.packbits(missing[i:j]).tobytes()]), pa.array([(offsets[i : j + 1] - offsets[i]).tobytes()]), pa.array([packer.compress(text.tobytes())])], ["block", "doc_ids", "missing", "ends", "text"])
                number += 1

    docs = only(docs, id_col, text_col)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "block long, doc_ids binary, missing binary, ends binary, text binary")


@dataclass
class Block:
    """A block's units: hashes or bytes, where each document begins among them, and where each unit begins and ends in the text."""

    doc_ids: np.ndarray
    ends: np.ndarray
    text: bytes
    plan: Windows
    missing: np.ndarray

    def __post_init__(self):
        self.flat = np.frombuffer(self.text, np.uint8)
        if self.plan.words:
            self.starts, self.stops, owner = words(self.flat, self.ends, SPACED_WORD)
            self.offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(self.doc_ids)))))
        else:
            self.offsets = self.ends

    @cached_property
    def units(self) -> np.ndarray:
        return word_hashes(self.flat, self.starts, self.stops, SPACED_WORD) if self.plan.words else self.flat

    @staticmethod
    def of(row: dict, plan: Windows) -> Block:
        ends = np.frombuffer(row["ends"], np.int64)
        return Block(np.frombuffer(row["doc_ids"], np.int64), ends, zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(int(ends[-1]), 1)) if ends[-1] else b"", plan, np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=len(ends) - 1).astype(bool))

    def digests(self) -> np.ndarray:
        """128-bit digests of the documents."""
        data = b"".join(xxhash.xxh3_128_digest(self.text[a:b]) for a, b in zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True))
        return np.frombuffer(data, np.dtype("V16"))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every run: first window, number of windows, minimizer hash and document (its place in the block)."""
        length, gram = self.plan.length, self.plan.gram
        n = len(self.units) - length + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64), np.zeros(0, np.int64))
        sizes = np.diff(self.offsets)
        edges = np.zeros(n + 1, np.int8)
        long = sizes >= length
        np.add.at(edges, self.offsets[:-1][long], 1)
        np.add.at(edges, self.offsets[1:][long] - length + 1, -1)
        valid = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
        grams, place = np.empty(n + self.plan.most - 1, U64), np.empty(n, np.int64)
        for a in range(0, n, STRETCH):
            b = min(n, a + STRETCH)
            own = gram_hashes(self.units[a : b + length - 1], gram)
            key = (own & ~PLACE) | np.arange(len(own), dtype=U64)
            grams[a : a + len(own)], place[a:b] = own, (sliding_min(key, self.plan.most) & PLACE).astype(np.int64) + a
        cut = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        first = np.concatenate(([0], np.flatnonzero(cut) + 1))
        count = np.diff(np.append(first, n))
        keep = valid[first]
        first, count = first[keep], count[keep]
        hashes = mix(grams[place[first]])
        return first, count, hashes, np.searchsorted(self.offsets, first, side="right") - 1

    def window_hashes(self, first: np.ndarray) -> np.ndarray:
        """A hash of all units of each of the given windows, taken in stretches."""
        out, length = np.empty(len(first), U64), self.plan.length
        order = np.argsort(first, kind="stable")
        for a in range(0, len(first), 1 << 16):
            part = order[a : a + (1 << 16)]
            low = int(first[part[0]])
            out[part] = gram_hashes(self.units[low : int(first[part[-1]]) + length], length)[first[part] - low]
        return out

    def strings(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The units of runs as rows, with zeros beyond the end."""
        at = first[:, None].astype(np.int32) + np.arange(self.plan.reach, dtype=np.int32)
        inside = np.arange(self.plan.reach) < (count + self.plan.length - 1)[:, None]
        return np.where(inside, self.units[np.minimum(at, len(self.units) - 1)], self.units.dtype.type(0))


#: Hashes of single bytes.
BYTES = mix(np.arange(1, 257, dtype=U64))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive units, put together from those of powers of two."""
    power, size = BYTES[units] if units.dtype != U64 else units, 1
    out, done = None, 0
    while True:
        if k & size:
            out = power if out is None else joined(out, power, done)
            done += size
        if done == k:
            return out
        power, size = joined(power, power, size), 2 * size


def joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    right = right[shift:]
    n = min(len(left), len(right))
    h = left[:n] * U64(0xD6E8FEB86659FD93)
    h += right[:n]
    h ^= h >> U64(32)
    h *= U64(0xC2B2AE3D27D4EB4F)
    return h


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys."""
    out, size = key, 1
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[: len(key) - width + 1], out[width - size : width - size + len(key) - width + 1]) if size < width else out


def as_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of a matrix as single values that sort and compare bytewise."""
    matrix = np.ascontiguousarray(matrix)
    return matrix.view(np.dtype((np.void, matrix.dtype.itemsize * matrix.shape[1]))).ravel()


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets that ascend with the hash."""
    return ((hashes >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def cuts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of an ascending array, and where it stands."""
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    for a, b in zip(starts, np.append(starts[1:], len(bucket)) if len(starts) else [], strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


def distinct(hashes: np.ndarray, doc_ids: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending hashes, and which of them occur again (strict: in another document)."""
    order = np.argsort(hashes, kind="stable")
    ordered, ids = hashes[order], doc_ids[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    if strict:
        return ordered[starts], np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
    return ordered[starts], np.diff(np.append(starts, len(ordered))) > 1


def minimal_ids(digests: np.ndarray, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests, the least identifier of each, and the number of each row's digest."""
    values, number = np.unique(digests, return_inverse=True)
    least = np.full(len(values), LAST_ID)
    np.minimum.at(least, number, doc_ids)
    return values, least, number


def short(hashes: np.ndarray) -> bytes:
    """The low five bytes of hashes: enough within a bucket, for it holds a bounded number of them, and a false mark costs only work."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def digest_bucket(digests: np.ndarray, n: int) -> np.ndarray:
    return (digests.view(U64).reshape(-1, 2)[:, 0] % U64(n)).astype(np.int64)


MARK_SCHEMA = "bucket int, block long, hashes binary, again binary, digests binary, least binary"
REPLY_SCHEMA = "bucket int, block long, marks binary, hot binary, least binary"


def send_minimizers(plan: Windows, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row, plan)
                _, _, hashes, doc = block.runs()
                hashes, again = distinct(hashes, block.doc_ids[doc], plan.strict) if len(hashes) else (hashes, np.zeros(0, bool))
                digests, least, _ = minimal_ids(block.digests(), block.doc_ids)
                order = np.argsort(digest_bucket(digests, n_buckets), kind="stable")
                ours = {k: (digests[order][s], least[order][s]) for k, s in cuts(digest_bucket(digests, n_buckets)[order])}
                rows = []
                for k, s in cuts(bucket_of(hashes, n_buckets)):
                    d, i = ours.pop(k, (digests[:0], least[:0]))
                    rows.append((k, row["block"], short(hashes[s]), np.packbits(again[s]).tobytes(), d.tobytes(), i.tobytes()))
                rows += [(k, row["block"], b"", b"", d.tobytes(), i.tobytes()) for k, (d, i) in ours.items()]
                if rows:
                    yield table(rows, MARK_SCHEMA)

    return run


def tables(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Entries handed on ENTRIES at a time: there are as many as blocks times buckets, so one batch for each would cost more than its contents."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ENTRIES:
            yield table(held, schema)
            held = []
    if held:
        yield table(held, schema)


def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def mark(hot_blocks: int):
    """For the entries of each block, in their order: which hashes occur in another entry, which in more than hot_blocks, and the least identifier of each digest."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, rows in by_bucket(batches):
            sizes = [len(r["hashes"]) // 5 for r in rows]
            wide = np.zeros((sum(sizes), 8), np.uint8)
            wide[:, :5] = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint8).reshape(-1, 5)
            hashes = wide.view(U64).ravel()
            order = np.argsort(hashes, kind="stable")
            same = hashes[order][1:] == hashes[order][:-1]
            marked = np.zeros(len(hashes), bool)
            marked[order[1:]] |= same
            marked[order[:-1]] |= same
            starts = np.flatnonzero(np.concatenate(([True], ~same))) if len(hashes) else np.zeros(0, np.int64)
            counts = np.diff(np.append(starts, len(hashes)))
            hot = np.zeros(len(hashes), bool)
            hot[order] = np.repeat(counts > hot_blocks, counts)
            digests = np.frombuffer(b"".join(r["digests"] for r in rows), np.dtype("V16"))
            _, least, number = minimal_ids(digests, np.frombuffer(b"".join(r["least"] for r in rows), np.int64))
            a = d = 0
            for r, n in zip(rows, sizes, strict=True):
                m = len(r["digests"]) // 16
                own = marked[a : a + n] | np.unpackbits(np.frombuffer(r["again"], np.uint8), count=n).astype(bool)
                yield r["bucket"], r["block"], np.packbits(own).tobytes(), np.packbits(hot[a : a + n]).tobytes(), least[number[d : d + m]].tobytes()
                a, d = a + n, d + m

    return lambda batches: tables(answers(batches), REPLY_SCHEMA)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one bucket after another; a partition sorted by bucket is never held whole."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != last and held:
                yield last, held
                held = []
            last = row["bucket"]
            held.append(row)
    if held:
        yield last, held


STRING_SCHEMA = "bucket int, block long, hashes binary, counts binary, strings binary, number binary, ids binary, place binary, first binary, settled binary"


def chosen_runs(block: Block, replies: list[dict], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, hash and document of the runs to send, and the windows of copies of earlier documents (first, number).

    Runs are those with a marked minimizer, in documents that are no copies. Runs of a minimizer that is met in very many
    blocks are cut into single windows, each under its own hash, so that no bucket holds all contexts of a frequent gram.
    """
    plan = block.plan
    first, count, hashes, doc = block.runs()
    by_bucket = {r["bucket"]: r for r in replies}
    copy = copies(block, by_bucket, n_buckets)
    known, at = np.unique(hashes, return_inverse=True)
    marks, hot = np.zeros(len(known), bool), np.zeros(len(known), bool)
    for k, s in cuts(bucket_of(known, n_buckets)):
        for bits, name in ((marks, "marks"), (hot, "hot")):
            bits[s] = np.unpackbits(np.frombuffer(by_bucket[k][name], np.uint8), count=s.stop - s.start)
    chosen = marks[at] & ~copy[doc] if len(known) else np.zeros(0, bool)
    first, count, hashes, doc, split = first[chosen], count[chosen], hashes[chosen], doc[chosen], hot[at][chosen] if len(known) else chosen
    if split.any():
        n = np.where(split, count, 1)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first, doc, split = np.repeat(first, n) + within, np.repeat(doc, n), np.repeat(split, n)
        count, hashes = np.where(split, 1, np.repeat(count, n)), np.repeat(hashes, n)
        hashes[split] = mix(block.window_hashes(first[split]))
    copied = np.column_stack((block.offsets[:-1][copy], np.diff(block.offsets)[copy] - plan.length + 1))
    return first, count, hashes, doc, copied[copied[:, 1] > 0]


def send_strings(plan: Windows, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row, plan)
                first, count, hashes, doc, copied = chosen_runs(block, row["replies"] or [], n_buckets)
                settled = [copied]
                rows = []
                if len(first):
                    ids, place = block.doc_ids[doc], first - block.offsets[doc]
                    strings = block.strings(first, count)
                    # Equal strings together, the earliest occurrence in front; ascending buckets.
                    _, number = np.unique(as_rows(np.column_stack((strings, count.astype(strings.dtype)))), return_inverse=True)
                    order = np.lexsort((place, ids, number, bucket_of(hashes, n_buckets)))
                    first, count, hashes, ids, place, number, strings = (x[order] for x in (first, count, hashes, ids, place, number, strings))
                    new = np.concatenate(([True], number[1:] != number[:-1]))
                    group = np.cumsum(new) - 1
                    heads = np.flatnonzero(new)
                    sent = (ids == ids[heads][group]) if plan.strict else new
                    settled.append(np.column_stack((first[~sent], count[~sent])))
                    for k, s in cuts(bucket_of(hashes[heads], n_buckets)):
                        h = heads[s]
                        a, b = np.searchsorted(group, (s.start, s.stop))
                        inside = a + np.flatnonzero(sent[a:b])
                        rows.append([k, row["block"], hashes[h].tobytes(), count[h].astype(np.uint8).tobytes(), packer.compress(strings[h].tobytes()), (group[inside] - s.start).astype(np.uint32).tobytes(), ids[inside].tobytes(), place[inside].astype(np.uint32).tobytes(), first[inside].astype(np.uint32).tobytes(), b""])
                settled = np.concatenate(settled).astype(np.uint32)
                if len(settled):
                    if not rows:
                        rows.append([int(row["block"]) % n_buckets, row["block"], *[b""] * 7, b""])
                    rows[0][-1] = settled.tobytes()
                if rows:
                    yield table([tuple(r) for r in rows], STRING_SCHEMA)

    return run


def copies(block: Block, replies: dict[int, dict], n_buckets: int) -> np.ndarray:
    """Which documents are copies of one with a smaller identifier."""
    digests, _, number = minimal_ids(block.digests(), block.doc_ids)
    bucket = digest_bucket(digests, n_buckets)
    order = np.argsort(bucket, kind="stable")
    least = np.full(len(digests), LAST_ID)
    for k, s in cuts(bucket[order]):
        least[order[s]] = np.frombuffer(replies[k]["least"], np.int64)
    return least[number] < block.doc_ids


FOUND_SCHEMA = "block long, first binary, masks binary, settled binary"


def resolve_strings(plan: Windows, resolver: Callable):
    """resolver(strings, counts, hashes, ids, places) gives, for every window of every distinct string, the identifier and place of its first occurrence."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        kind = U64 if plan.words else np.uint8
        for _, rows in by_bucket(batches):
            full = [r for r in rows if r["counts"]]
            if full:
                counts = np.frombuffer(b"".join(r["counts"] for r in full), np.uint8).astype(np.int64)
                hashes = np.frombuffer(b"".join(r["hashes"] for r in full), U64)
                width = plan.reach * np.dtype(kind).itemsize
                strings = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["strings"], max_output_size=len(r["counts"]) * width) for r in full), kind).reshape(-1, plan.reach)
                ids = np.frombuffer(b"".join(r["ids"] for r in full), np.int64)
                place = np.frombuffer(b"".join(r["place"] for r in full), np.uint32).astype(np.int64)
                base = np.concatenate(([0], np.cumsum([len(r["counts"]) for r in full])[:-1]))
                number = np.concatenate([np.frombuffer(r["number"], np.uint32).astype(np.int64) + b for r, b in zip(full, base, strict=True)])
                _, heads, same = np.unique(as_rows(np.column_stack((strings, counts.astype(kind)))), return_index=True, return_inverse=True)
                of = same[number]
                order = np.lexsort((place, ids, of))
                starts = order[np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1])))]
                first_id, first_place = resolver(strings[heads], counts[heads], hashes[heads], ids[starts], place[starts])
                window = np.arange(plan.most)
                earlier = first_id[of] < ids[:, None]
                if not plan.strict:
                    earlier |= (first_id[of] == ids[:, None]) & (first_place[of] < place[:, None] + window)
                earlier &= window < counts[heads][of][:, None]
                masks = (earlier.astype(U64) << window.astype(U64)).sum(axis=1, dtype=U64)
            a = 0
            for r in rows:
                n = len(r["ids"]) // 8
                if n:
                    own, first = masks[a : a + n], np.frombuffer(r["first"], np.uint32)
                    a += n
                    some = own != 0
                    own, first = own[some], first[some]
                else:
                    own, first = np.zeros(0, U64), np.zeros(0, np.uint32)
                if len(own) or r["settled"]:
                    yield r["block"], first.tobytes(), own.tobytes(), r["settled"]

    return lambda batches: tables(answers(batches), FOUND_SCHEMA)


def removed_units(block: Block, replies: list[dict]) -> np.ndarray:
    """Which units are covered by a window that occurs earlier."""
    n = len(block.units)
    edges = np.zeros(n + block.plan.length + 1, np.int64)
    settled = np.frombuffer(b"".join(r["settled"] for r in replies), np.uint32).reshape(-1, 2).astype(np.int64)
    np.add.at(edges, settled[:, 0], 1)
    np.add.at(edges, settled[:, 0] + settled[:, 1] + block.plan.length - 1, -1)
    first, masks = np.frombuffer(b"".join(r["first"] for r in replies), np.uint32).astype(np.int64), np.frombuffer(b"".join(r["masks"] for r in replies), U64)
    for o in range(block.plan.most):
        at = first[(masks >> U64(o)) & U64(1) == 1] + o
        np.add.at(edges, at, 1)
        np.add.at(edges, at + block.plan.length, -1)
    return np.cumsum(edges)[:n] > 0


def kept_text(block: Block, gone: np.ndarray, k: int) -> bytes:
    """What is left of document k: its other bytes, or its other words joined by one space."""
    a, b = int(block.offsets[k]), int(block.offsets[k + 1])
    left = ~gone[a:b]
    if not block.plan.words:
        return block.text[a:b] if left.all() else block.flat[a:b][left].tobytes()
    return b" ".join([block.text[x:y] for x, y in zip(block.starts[a:b][left].tolist(), block.stops[a:b][left].tolist(), strict=True)])


def results(block: Block, gone: np.ndarray) -> pa.RecordBatch:
    """doc_id, n_units, spans and kept of the documents of a block."""
    owner = np.repeat(np.arange(len(block.doc_ids)), np.diff(block.offsets))
    if len(gone):
        begin = gone & np.concatenate(([True], ~gone[:-1] | (owner[1:] != owner[:-1])))
        end = gone & np.concatenate((~gone[1:] | (owner[1:] != owner[:-1]), [True]))
        a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    else:
        a = b = np.zeros(0, np.int64)
    of = owner[a] if len(a) else np.zeros(0, np.int64)
    spans = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(block.doc_ids))))).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(a - block.offsets[of]), pa.array(b - block.offsets[of])], ["start", "end"]),
    )
    return pa.RecordBatch.from_arrays([
        pa.array(block.doc_ids, mask=block.missing), pa.array(np.diff(block.offsets).astype(np.int64)), spans,
        pa.array([kept_text(block, gone, k) for k in range(len(block.doc_ids))], pa.binary()),
    ], ["doc_id", "n_units", "spans", "kept"])


def finish(plan: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row, plan)
                yield results(block, removed_units(block, row["replies"] or []))

    return run


def remove_repeats(docs: DataFrame, plan: Windows, resolver: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_units, spans (removed stretches, in units) and kept (the bytes that are left).

    A unit is removed if a window over it occurs earlier: in a document with a smaller identifier or, unless plan.strict,
    at a smaller place of the same document. Windows are judged on the input. Null texts have no units; null identifiers
    come after all others; rows that share one, null too, are compared by the places of their windows, so copies of equal
    identifiers stay. Further columns are ignored.
    """
    spread = Spread.of(docs, plan, id_col, text_col)
    strings = spread.exchange(spread.marked().mapInArrow(send_strings(plan, spread.n), STRING_SCHEMA))
    found = strings.mapInArrow(resolve_strings(plan, resolver), FOUND_SCHEMA)
    return spread.with_replies(found, "first", "masks", "settled").mapInArrow(finish(plan), RESULT_SCHEMA)


RESULT_SCHEMA = "doc_id long, n_units long, spans array<struct<start:bigint,end:bigint>>, kept binary"


@dataclass
class Spread:
    """Stored blocks of documents and the number of buckets for their exchanges."""

    blocks: DataFrame
    plan: Windows
    n: int

    @staticmethod
    def of(docs: DataFrame, plan: Windows, id_col: str, text_col: str) -> Spread:
        spark = docs.sparkSession
        path = scratch(spark, "blocks")
        to_blocks(docs, id_col, text_col).write.option("compression", "none").parquet(path)
        blocks = spark.read.parquet(path)
        size = blocks.agg(F.sum(F.expr("cast(octet_length(text) as bigint)"))).first()[0] or 0
        return Spread(blocks.select("block", "doc_ids", "missing", "ends", "text"), plan, buckets(spark, 3 * size, BUCKET_BYTES))

    def exchange(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionById(self.n, F.col("bucket")).sortWithinPartitions("bucket", "block")

    def with_replies(self, replies: DataFrame, *columns: str) -> DataFrame:
        """Blocks with the replies to them: as many as buckets at most, with bits and places of the block's own entries."""
        found = replies.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("replies"))
        return self.blocks.join(found, "block", "left").select(*self.blocks.columns, "replies")

    def marked(self) -> DataFrame:
        """Blocks with the marks of their minimizers."""
        marks = self.exchange(self.blocks.mapInArrow(send_minimizers(self.plan, self.n), MARK_SCHEMA)).mapInArrow(mark(HOT_BLOCKS), REPLY_SCHEMA)
        return self.with_replies(marks, "bucket", "marks", "hot", "least")


def digests(rows: DataFrame, unit: str, text: Column | None = None) -> DataFrame:
    """doc_id (null where the row has none), n_<unit>, n_removed, n_spans and kept_sha256 from the operator's rows."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", F.col("n_units").alias(f"n_{unit}"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
