"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, list_array, only, slices, utf8
from .tokenize import blank_pieces, has_word_ends, vocabulary_path

#: Texts that are encoded together; their new words are merged at once.
SLICE_BYTES = 2 << 20
_NEVER = 1 << 62
_PLACE = (1 << 32) - 1


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[int, int], results: list[int]) -> list[int]:
    """Merge adjacent pairs, always the leftmost of the lowest rank, until no pair has a rank.

    The leaves of the tree are the pairs (rank and place, so that the least is the leftmost of the lowest rank), its root is
    the next merge, and a merge changes three leaves: its own pair, the pair before and the pair that vanishes.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = [_NEVER] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(symbols[i] << 20 | symbols[i + 1])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, value: int) -> None:
        at = size + place
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                return
            tree[at] = least
            at >>= 1

    def pair(left: int, right: int) -> int:
        rank = ranks.get(symbols[left] << 20 | symbols[right])
        return _NEVER if rank is None else rank << 32 | left

    while (root := tree[1]) != _NEVER:
        i = root & _PLACE
        j = after[i]
        k = after[j]
        symbols[i] = results[root >> 32]
        after[i] = k
        if j < n - 1:
            put(j, _NEVER)
        if k < n:
            before[k] = i
            put(i, pair(i, k))
        else:
            put(i, _NEVER)
        if before[i] >= 0:
            put(before[i], pair(before[i], i))
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class PairRanks:
    """Ranks of pairs of symbols by open addressing, for whole arrays of pairs; -1 where a pair has none."""

    BITS = 18
    FREE = np.uint32(0xFFFFFFFF)

    def __init__(self, pairs: np.ndarray):
        """pairs: rows of two symbols, in the order of their ranks; of a repeated pair the first counts."""
        keys, first = np.unique(self.keys(pairs[:, 0], pairs[:, 1]), return_index=True)
        if len(keys) > 1 << (self.BITS - 1):
            raise ValueError(f"more than {1 << (self.BITS - 1)} merges")
        self.table, self.ranks = np.full(1 << self.BITS, self.FREE), np.full(1 << self.BITS, -1, np.int32)
        at = self.places(keys)
        while len(keys):
            here = np.flatnonzero(self.table[at] == self.FREE)
            here = here[np.unique(at[here], return_index=True)[1]]
            self.table[at[here]], self.ranks[at[here]] = keys[here], first[here]
            keys, first, at = np.delete(keys, here), np.delete(first, here), np.delete(at, here)
            at = (at + 1) & ((1 << self.BITS) - 1)

    @staticmethod
    def keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) >> np.uint32(32 - self.BITS)).astype(np.int32)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self.keys(left, right)
        at = self.places(keys)
        found = self.table[at]
        out = np.where(found == keys, self.ranks[at], np.int32(-1))
        rest = np.flatnonzero((found != keys) & (found != self.FREE))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.BITS) - 1)
            found, own = self.table[at[rest]], keys[rest]
            out[rest] = np.where(found == own, self.ranks[at[rest]], np.int32(-1))
            rest = rest[(found != own) & (found != self.FREE)]
        return out


def merge_rows(symbols: np.ndarray, n: np.ndarray, ranks: PairRanks, results: np.ndarray) -> None:
    """`merge` on many words at once, one in each row of symbols, n long; -1 is left where a symbol is merged away.

    All words have segment trees of one shape: the leaves of a row are its pairs (rank and place in one number), and a merge
    puts three leaves, whose paths to the root are mended level by level. Rows drop out when their root has no pair left.
    """
    size = symbols.shape[1] - 1
    shift, never = np.int32(size.bit_length() - 1), np.int32((1 << 31) - 1)
    place = np.arange(size, dtype=np.int32)
    rank = ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(-1, size)
    tree = np.empty((len(symbols), 2 * size), np.int32)
    tree[:, size:] = np.where((rank >= 0) & (place < n[:, None] - 1), rank << shift | place, never)
    level = size >> 1
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level >>= 1
    wide = size + 1
    after = np.tile(np.arange(1, wide + 1, dtype=np.int32), (len(symbols), 1)).ravel()
    before = np.tile(np.arange(-1, wide - 1, dtype=np.int32), (len(symbols), 1)).ravel()
    nodes, own = tree.ravel(), symbols.ravel()
    live = np.arange(len(symbols), dtype=np.int32)
    while True:
        root = nodes[live * (2 * size) + 1]
        some = root != never
        if not some.all():
            live, root = live[some], root[some]
        if not len(live):
            return
        base, top, end = live * wide, live * (2 * size) + size, n[live]
        i = root & np.int32(size - 1)
        j = after[base + i]
        k = after[base + j]
        own[base + i], own[base + j] = results[root >> shift], -1
        after[base + i] = k
        inner = k < end
        before[(base + k)[inner]] = i[inner]
        h = before[base + i]
        left = np.maximum(h, 0)
        # Three leaves: the vanished pair, the merged symbol's own pair and the pair before it. The last place has no leaf.
        rank = ranks(np.concatenate((own[base + i], own[base + left])), np.concatenate((own[base + np.minimum(k, size)], own[base + i])))
        mine, prior = rank[: len(live)], rank[len(live) :]
        last = j >= end - 1
        at = np.concatenate((top + np.where(last, i, j), top + i, (top + left)[h >= 0]))
        value = np.concatenate((np.full(len(live), never), np.where(inner & (mine >= 0), mine << shift | i, never), np.where(prior >= 0, prior << shift | left, never)[h >= 0]))
        nodes[at] = value
        row = np.concatenate((live, live, live[h >= 0])) * (2 * size)
        at -= row
        for _ in range(int(shift)):
            at >>= 1
            low = row + 2 * at
            nodes[row + at] = np.minimum(nodes[low], nodes[low + 1])


class Bpe:
    """Encoder and decoder from a tokenizer file: NFC, blanks, lower case, a split pattern, byte-level BPE with word ends, no decoder."""

    #: Pieces that a worker keeps from one slice to the next, words with trees of one shape that are merged at once, and the
    #: longest word (in pairs) among them; longer ones are merged by themselves. None of them changes a result.
    KEPT, ROWS, PAIRS = 100_000, 4096, 64

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        if not has_word_ends(spec):
            raise ValueError(f"{path} is no vocabulary with word ends; other kinds are split and merged otherwise")
        vocab, model = spec["model"]["vocab"], spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.results = [vocab[a + b] for a, b in pairs]
        self.pair_ranks, self.pair_results = PairRanks(np.array([(vocab[a], vocab[b]) for a, b in pairs])), np.array(self.results, np.int32)
        characters, end = byte_characters(), model["end_of_word_suffix"]
        self.inner, self.last = (np.array([vocab[c + suffix] for c in characters], np.int32) for suffix in ("", end))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.split, self.split_lines = regex.compile(pattern), regex.compile(pattern + r"|\n")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self.spaced = [" " + t for t in self.tokens]
        self.token_chars = np.array([len(t) for t in self.spaced])
        #: By piece: its ids, and their tokens, each with a space in front. What is full becomes the old generation.
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self.old_ids: dict[str, bytes] = {}
        self.old_texts: dict[str, str] = {}

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths)
        begins = ends - lengths
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        shape = np.where(lengths > 1, 1 << np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64), 0)
        for size in np.unique(shape[shape > 0]).tolist():
            chosen = np.flatnonzero(shape == size)
            for a in range(0, len(chosen) if size <= self.PAIRS else 0, self.ROWS):
                part = chosen[a : a + self.ROWS]
                at = begins[part][:, None] + np.arange(size + 1)
                inside = at < ends[part][:, None]
                rows = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], np.int32(0))
                merge_rows(rows, lengths[part], self.pair_ranks, self.pair_results)
                symbols[at[inside]] = rows[inside]
            for w in chosen if size > self.PAIRS else ():
                ids = merge(symbols[begins[w] : ends[w]].tolist(), self.ranks, self.results)
                symbols[begins[w] : ends[w]] = ids + [-1] * (int(lengths[w]) - len(ids))
        left = symbols >= 0
        before = np.concatenate(([0], np.cumsum(left)))
        return symbols[left], before[ends] - before[begins]

    @staticmethod
    def normalise(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # no final sigma: each character by itself

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces: their distinct words are merged together."""
        odd = {p for p in pieces if "<" in p and self.find_added.search(p) or p.split() != [p]}
        if odd:
            pieces = [p for p in pieces if p not in odd]
        found = self.split_lines.findall(self.normalise("\n".join(pieces) + "\n")) if pieces else []
        for piece in odd:
            for part in self.find_added.split(piece):
                found += [part] if part in self.added else self.split.findall(self.normalise(part))
            found.append("\n")
        words = list(set(found).difference(self.added, ("\n",)))
        ids, counts = self.words([w.encode() for w in words]) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        ids, counts = np.concatenate((ids, np.array([*self.added.values()], np.int32))), np.concatenate((counts, np.ones(len(self.added), np.int64)))
        numbers = dict(zip([*words, *self.added, "\n"], [*range(len(words) + len(self.added)), -1], strict=True))
        number = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
        used = number[number >= 0]
        begins = (np.cumsum(counts) - counts)[used]
        sizes = counts[used]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        # Pieces end where -1 stands: after so many words, ids and characters of the decoded text.
        after = np.concatenate(([0], ends))[np.cumsum(number >= 0)[number < 0]]
        chars = np.concatenate(([0], np.cumsum(self.token_chars[flat])))[after]
        data, text = flat.astype("<i4").tobytes(), "".join(map(self.spaced.__getitem__, flat.tolist()))
        pieces = [*pieces, *odd]
        for kept, whole, cuts in ((self.ids, data, (4 * after).tolist()), (self.texts, text, chars.tolist())):
            kept.update(zip(pieces, [whole[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Of each text the ids, as little-endian 32-bit integers, and what they decode to: the tokens joined by one space, special ones too."""
        if len(self.ids) > self.KEPT:
            self.old_ids, self.old_texts, self.ids, self.texts = self.ids, self.texts, {}, {}
        pieces = [blank_pieces(t) for t in texts]
        new = set().union(*pieces).difference(self.ids)
        kept = new.intersection(self.old_ids)
        self.ids.update(zip(kept, map(self.old_ids.__getitem__, kept), strict=True))
        self.texts.update(zip(kept, map(self.old_texts.__getitem__, kept), strict=True))
        self.learn(list(new - kept))
        ids, text = self.ids.__getitem__, self.texts.__getitem__
        return [b"".join(map(ids, own)) for own in pieces], ["".join(map(text, own))[1:] for own in pieces]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_BPE: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _BPE:
        _BPE[path] = Bpe(path)
    return _BPE[path]


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row, and with decode the text that those ids decode to, in one pass.

    Whole texts; null counts as empty. Rows repeat as they do in docs, and further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                data, texts = coder.encode([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                ids = list_array(np.array([len(d) // 4 for d in data], np.int64), pa.array(np.frombuffer(b"".join(data), "<i4")))
                decoded = [pa.array(texts, pa.string())] if decode else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids, *decoded], ["doc_id", "ids", "decoded"][: 2 + decode])

    docs = only(docs, id_col, text_col)
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, ids array<int>" + ", decoded string" * decode)


def bpe_decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column decoded, from stored ids; null ids decode to the empty text, and ids that the vocabulary lacks are left out."""

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        coder = bpe(tokenizer)
        known = len(coder.tokens)
        return pd.Series([coder.decode([] if x is None else x[(x >= 0) & (x < known)].tolist()) for x in column], dtype=object)

    return rows.withColumn("decoded", decode(F.col(ids_col)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over all documents: doc_id, n_tokens, ids_sha256, decoded_sha256 (see `bpe_encode`)."""
    rows = bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("word_bpe_49k.json"), decode=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
