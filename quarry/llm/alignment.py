"""Alignment of two tokenizers: where both end a token the text is cut into groups, and tokens that end together are linked.

Texts are cut at blanks into units across which neither vocabulary can join anything; a worker aligns each unit once and keeps it.
A block of documents leaves with its distinct linked pairs and, for each document, places in that list, so a pair travels once
a block however often it occurs. Pairs are counted in two stages, and the counts come back to the blocks by joins.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, join_by_key, only, stage
from .tokenize import load, vocabulary_path

#: Bytes of text in a block; units that a worker keeps; units encoded together. None changes a result.
BLOCK_BYTES, MOST_UNITS, TOGETHER = 8 << 20, 400_000, 4000
#: Shares into which the rows of a pair are dealt before they are added up.
SALTS = 16
#: A unit: blanks, and all up to the next blank.
UNIT = re.compile(r"[ \n]*[^ \n]+")
_MADE: dict[tuple[str, str, str], object] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """The byte-level vocabulary, special tokens taken as plain text."""

    def __init__(self, path: str):
        self.tokenizer = load(path, plain_specials=True)
        letters = byte_letters()
        self.values = [b""] * self.tokenizer.get_vocab_size()
        for piece, i in self.tokenizer.get_vocab().items():
            self.values[i] = bytes(letters[c] for c in piece)
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        #: Units are independent: blanks begin the parts that are merged, and nothing is rewritten or added before.
        self.by_unit = made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that begins with a space."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """The sentence-piece vocabulary, which adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.values = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Units are independent: no piece has a space after anything else, and none holds a line feed.
        self.by_unit = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text[1:]), np.int64)


@dataclass(frozen=True)
class Aligned:
    """Tokens of some text: ids and ends (in bytes) of both, common cuts, and linked tokens by their places."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    cuts: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, rule: str = "end") -> Aligned:
    """Groups and links of two token sequences over the same bytes.

    rule "end" links tokens whose byte ranges end together; "overlap" links tokens that share a byte.
    """
    ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if rule == "end":
        first, last = np.searchsorted(ends_b, ends_a, side="left"), np.searchsorted(ends_b, ends_a, side="right")
    else:
        first, last = np.searchsorted(ends_b, ends_a - sizes_a[a], side="right"), np.searchsorted(ends_b - sizes_b[b], ends_a, side="left")
    n = last - first
    link_a = np.repeat(np.arange(len(a)), n)
    link_b = np.arange(len(link_a)) + np.repeat(first - (np.cumsum(n) - n), n)
    return Aligned(a, b, ends_a, ends_b, cuts, link_a, link_b)


class Growing:
    """An array that is appended to."""

    def __init__(self, dtype=np.int64):
        self.data, self.n = np.zeros(1024, dtype), 0

    def append(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def __getitem__(self, at):
        return self.data[: self.n][at]


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[k], begins[k] + 1, ... for each k, counts[k] of them."""
    return np.arange(int(counts.sum())) + np.repeat(begins - (np.cumsum(counts) - counts), counts)


class Aligner:
    """Aligns whole texts; units met before are looked up."""

    def __init__(self, path_a: str, path_b: str, rule: str = "end"):
        self.side_a, self.side_b, self.rule = ByteLevel(path_a), Pieces(path_b), rule
        self.sizes_a, self.sizes_b = (np.array([len(v) for v in s.values], np.int64) for s in (self.side_a, self.side_b))
        self.by_unit = self.side_a.by_unit and self.side_b.by_unit
        n_a, n_b = len(self.sizes_a), len(self.sizes_b)
        #: How a token is written in a groups text, by what follows it: another of its side, the other side, a group, a unit.
        self.signs = [f"{i}," for i in range(n_a)] + [f"{i}|" for i in range(n_a)] + [f"{i}{s}" for s in ",;\n" for i in range(n_b)]
        self.reset()

    def reset(self) -> None:
        self.units: dict[str, int] = {}
        self.texts: list[str] = []
        self.keys, self.numbers, self.begins = Growing(), Growing(), Growing()

    def encode(self, text: str) -> Aligned | None:
        """None if the tokens of one side don't make up the text."""
        a, b, data = self.side_a.encode(text), self.side_b.encode(text), text.encode()
        if b"".join(map(self.side_a.values.__getitem__, a)) != data or b"".join(map(self.side_b.values.__getitem__, b)) != data:
            return None
        return align(a, b, self.sizes_a, self.sizes_b, self.rule)

    def written(self, x: Aligned, unit_ends: np.ndarray) -> list[str]:
        """The groups of each unit as text: ids of one side, a bar, ids of the other, with a semicolon between groups."""
        n_a, n_b = len(self.sizes_a), len(self.sizes_b)
        group_a, group_b = np.searchsorted(x.cuts, x.ends_a), np.searchsorted(x.cuts, x.ends_b)
        codes = np.empty(len(x.a) + len(x.b), np.int64)
        codes[np.arange(len(x.a)) + np.searchsorted(group_b, group_a)] = x.a + n_a * np.isin(x.ends_a, x.cuts, assume_unique=True)
        after = np.isin(x.ends_b, x.cuts, assume_unique=True).astype(np.int64) + np.isin(x.ends_b, unit_ends, assume_unique=True)
        codes[np.arange(len(x.b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * n_a + n_b * after + x.b
        return "".join(map(self.signs.__getitem__, codes.tolist())).split("\n")[:-1]

    def learn(self, units: list[str]) -> None:
        """Align new units together; a unit that cannot stand for itself is marked -1."""
        fit = [u for u in units if not u[-1].isspace()]
        self.units.update(dict.fromkeys(set(units).difference(fit), -1))
        for i in range(0, len(fit), TOGETHER):
            self.add(fit[i : i + TOGETHER])

    def add(self, units: list[str]) -> None:
        if not units:
            return
        x = self.encode(" x" + "".join(units))
        ends = 2 + np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in units])
        if x is None or not np.isin(np.append(ends, 2), x.cuts).all():
            if len(units) == 1:
                self.units[units[0]] = -1
            else:
                self.add(units[: len(units) // 2])
                self.add(units[len(units) // 2 :])
            return
        per_a, per_b, per_group, per_link = (np.diff(np.searchsorted(e, np.append(2, ends), side="right")) for e in (x.ends_a, x.ends_b, x.cuts, x.ends_a[x.link_a]))
        real = x.ends_a[x.link_a] > 2
        begin = self.keys.n
        self.keys.append((x.a[x.link_a] * len(self.sizes_b) + x.b[x.link_b])[real])
        self.numbers.append(np.stack((per_a, per_b, per_group, per_link), axis=1).ravel())
        self.begins.append(begin + np.cumsum(per_link) - per_link)
        self.units.update(zip(units, range(len(self.texts), len(self.texts) + len(units)), strict=True))
        self.texts += self.written(x, np.append(2, ends))[1:]

    def units_of(self, text: str) -> list[str] | None:
        """The units of a space and the text; None if it ends in a blank."""
        if text[-1] in " \n":
            return None
        if "\0" in text or text[0] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return UNIT.findall(" " + text)
        return (" " + text.replace(" ", "\0 ").replace("\n", "\0\n")).split("\0")

    def texts_of(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, str]]:
        """For each text n_a, n_b, n_groups, n_links; the keys of its links in order; its groups as text."""
        if len(self.units) > MOST_UNITS:
            self.reset()
        cut = [self.units_of(t) if t and self.by_unit else None for t in texts]
        new = set().union(*filter(None, cut)).difference(self.units)
        self.learn(list(new))
        value, out = self.units.__getitem__, []
        nothing = np.zeros(4, np.int64), np.zeros(0, np.int64), ""
        for text, units in zip(texts, cut, strict=True):
            if not text:
                out.append(nothing)
                continue
            places = list(map(value, units)) if units else [-1]
            if min(places) < 0:
                out.append(self.whole(text) or nothing)
                continue
            at = np.array(places)
            numbers = self.numbers[:].reshape(-1, 4)[at]
            out.append((numbers.sum(axis=0), self.keys[spread(self.begins[at], numbers[:, 3])], ";".join(map(self.texts.__getitem__, places))))
        return out

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray, str] | None:
        x = self.encode(" " + text)
        if x is None:
            return None
        numbers = np.array([len(x.a), len(x.b), len(x.cuts), len(x.link_a)], np.int64)
        return numbers, x.a[x.link_a] * len(self.sizes_b) + x.b[x.link_b], self.written(x, x.ends_b[-1:])[0]


def aligner(path_a: str, path_b: str, rule: str) -> Aligner:
    """One for each worker."""
    key = path_a, path_b, rule
    if key not in _MADE:
        _MADE[key] = Aligner(*key)
    return _MADE[key]


@dataclass(frozen=True)
class Alignment:
    """documents: a row a document (see `align_tokenizers`); pairs: a_id, b_id, n_links over all documents, best (the most of its b_id)."""

    documents: DataFrame
    pairs: DataFrame


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def blocks_of(docs: DataFrame, path_a: str, path_b: str, rule: str, with_groups: bool) -> DataFrame:
    """Rows of documents (links: places in the block's list of pairs, as 32-bit integers) and a row a block with its pairs and their counts."""
    kind = docs.schema[0].dataType.simpleString()
    schema = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary, pair_key array<long>, pair_n array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, held, size, block = aligner(path_a, path_b, rule), [], 0, TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            keys, places, counts = np.unique(np.concatenate([k for _, _, k, _, _ in held]), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(k) for _, _, k, _, _ in held])
            links = [p.astype("<i4").tobytes() for p in np.split(places, ends[:-1])]
            numbers = np.array([n for _, n, _, _, _ in held])
            none, m = [None], len(held)
            return pa.RecordBatch.from_arrays([
                pa.array([block] * (m + 1), pa.int64()), pa.array([i for i, *_ in held] + none, held_type), *[pa.array([*numbers[:, c].tolist(), None], pa.int64()) for c in range(4)],
                pa.array([s for _, _, _, s, _ in held] + none, pa.string()), pa.array([g for *_, g in held] + none, pa.string()), pa.array(links + none, pa.binary()),
                pa.array([None] * m + [keys], pa.list_(pa.int64())), pa.array([None] * m + [counts], pa.list_(pa.int64())),
            ], ["block", "doc_id", *NUMBERS, "groups_sha256", "groups", "links", "pair_key", "pair_n"])

        held_type: pa.DataType = pa.null()
        for batch in batches:
            held_type, texts = batch.column(0).type, batch.column(1).to_pylist()
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                for doc_id, text, (numbers, keys, groups) in zip(batch.column(0).slice(i, 512).to_pylist(), part, work.texts_of(part), strict=True):
                    sha = hashlib.sha256(groups.encode()).hexdigest() if numbers[0] else ""
                    held.append((doc_id, numbers, keys, sha, groups if with_groups else None))
                    size += len(text or "")
                    if size >= BLOCK_BYTES:
                        yield close()
                        held, size, block = [], 0, block + 1
        if held:
            yield close()

    return docs.mapInArrow(run, schema)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "end", with_groups: bool = False) -> Alignment:
    """Align a byte-level vocabulary (A, of a space and the text) with a sentence-piece one (B) over every whole text.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is linked as often as any pair of its B id), count_sum
    (corpus-wide links of their pairs, over the links), groups_sha256 of `a1,a2|b1;a3|b2,b3`, and groups, that text itself, if
    with_groups. Texts that are null or empty, or that the joined bytes of one side don't make up (U+2581), have zeros and ''.
    Rows repeat as in docs, each counted; ids may be null; an empty table gives none. A document is held by one task, as are the
    pairs of a block; what is broadcast is a bounded number of hot pairs.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = stage(blocks_of(only(docs, id_col, text_col), path_a, path_b, rule, with_groups), "aligned")
    pairs = parts.filter("pair_key IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pair_key", "pair_n")).alias("place", "p")).select("block", "place", F.col("p.pair_key").alias("key"), F.col("p.pair_n").alias("n"))
    salted = pairs.groupBy("key", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"), F.count("*").alias("n_blocks"))
    counts = salted.groupBy("key").agg(F.sum("n").alias("total"), F.sum("n_blocks").alias("n_blocks"))
    size_b = vocabulary_size(path_b)
    counts = counts.withColumn("b_id", F.pmod("key", F.lit(size_b)))
    most = counts.groupBy("b_id").agg(F.max("total").alias("most"))
    # At most one row for each id of A and B each: an id of B has no more rows than A has ids.
    counts = stage(counts.join(most, "b_id").select("key", "total", "n_blocks", (F.col("total") == F.col("most")).alias("best")), "pair-counts")
    n_rows = counts.agg(F.sum("n_blocks").alias("n")).first()["n"] or 0
    replies = join_by_key(pairs.select("block", "place", "key"), counts, ["key"], n_rows, "n_blocks").select(F.col("block").alias("to_block"), "place", "total", "best")
    rows = parts.filter("pair_key IS NULL").drop("pair_key", "pair_n")

    def attach(left: pa.Table, right: pa.Table) -> pa.Table:
        places = right.column("place").to_numpy()
        total, best = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        total[places], best[places] = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        own = [np.frombuffer(x.as_buffer() if x.as_buffer() is not None else b"", "<i4") for x in left.column("links")]
        sums = [[int(v[x].sum()) for x in own] for v in (best, total)]
        keep = left.select(["doc_id", *NUMBERS]).append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))
        return keep.append_column("groups_sha256", left.column("groups_sha256")).append_column("groups", left.column("groups"))

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, n_best long, count_sum long, groups_sha256 string, groups string"
    found = rows.groupBy("block").cogroup(replies.groupBy("to_block")).applyInArrow(attach, schema)
    table = counts.select(F.floor(F.col("key") / size_b).cast("int").alias("a_id"), F.pmod("key", F.lit(size_b)).cast("int").alias("b_id"), F.col("total").alias("n_links"), "best")
    return Alignment(found if with_groups else found.drop("groups"), table)


def vocabulary_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11 over all documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see `align_tokenizers`)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokenizers(docs, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")).documents
