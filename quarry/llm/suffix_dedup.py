"""Suffix-array deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Stretches that may repeat are brought together by Spark (see `repeats`); the distinct ones of a bucket make up one text. Its
transform is expanded breadth first: the intervals of all strings of one symbol, extended backwards by one symbol, give those
of two symbols, and so on. A border that first shows between two neighbours of the suffix order at level l is a common prefix
of l symbols, so common prefixes come out by increasing value, and the expansion stops at the wanted length: neighbours
without a border by then share at least that many bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import U64
from .repeats import LAST_ID, Windows, digests, gram_hashes, remove_repeats

#: Text that is transformed at once, unless stretches with one minimizer are longer.
CHUNK_BYTES = 1 << 18
#: Strings whose windows are hashed at once.
HASHED = 1 << 10
END, BETWEEN, FIRST_BYTE = 0, 1, 2


def suffix_order(text: np.ndarray, least: int) -> np.ndarray:
    """Starts of all suffixes, ascending by their first `least` symbols or more, by doubling the sorted depth.

    Suffixes that are still equal at that depth stand together, in any order: so do they without their first symbol, and no
    common prefix below `least` depends on it. The last symbol must occur once and be the least.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(7, text.dtype))).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        key |= padded[j : j + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(starts, sizes)
    tied = order[np.repeat(sizes > 1, sizes)]
    depth = 7
    while len(tied) and depth <= least:
        following = tied + depth
        key = rank[tied].astype(np.int64) << 32
        key |= np.where(following < n, rank[np.minimum(following, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = (key >> 32).astype(np.int32)
        place = np.arange(len(tied), dtype=np.int32)
        group = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), place, 0))
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(tied)))
        rank[tied] = old + np.repeat(starts, sizes) - group
        tied = tied[np.repeat(sizes > 1, sizes)]
        depth *= 2
    if len(tied):
        same = rank[tied]
        place = np.arange(len(tied), dtype=np.int32)
        rank[tied] += place - np.maximum.accumulate(np.where(np.concatenate(([True], same[1:] != same[:-1])), place, 0))
    order = np.empty(n, np.int32)
    order[rank] = np.arange(n, dtype=np.int32)
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each suffix, in order, the symbols it shares with the one before; `least` stands for that many or more."""
    bwt = text[order - 1]
    step = np.argsort(bwt, kind="stable").astype(np.int32)  # where the suffix without its first symbol stands: the inverse of the last-to-first map
    first = bwt[step]
    shared = np.full(len(text), least, np.int8 if least < 128 else np.int32)
    border = np.concatenate(([True], first[1:] != first[:-1]))
    shared[border] = 0
    open_ = np.flatnonzero(~border)
    low, high = step[open_ - 1], step[open_]
    before = np.zeros(len(open_), bool)
    for level in range(1, least):
        interval = np.cumsum(border, dtype=np.int32)
        apart = interval[low] != interval[high]
        found = open_[apart > before]
        if not len(found):
            break
        shared[found] = level
        border[found] = True
        before = apart
        if np.count_nonzero(apart) > len(open_) // 8:
            rest = ~apart
            open_, low, high = open_[rest], low[rest], high[rest]
            before = np.zeros(len(open_), bool)
    return shared


def first_documents(strings: np.ndarray, counts: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each window of each string the least identifier of a string that holds the same window."""
    sizes = counts + length - 1
    wide = np.full((len(strings), strings.shape[1] + 1), BETWEEN, np.uint16)
    wide[:, :-1] = strings.astype(np.uint16) + FIRST_BYTE
    column = np.arange(wide.shape[1])
    wide[np.arange(len(strings)), sizes] = BETWEEN
    used = column <= sizes[:, None]
    text = np.append(wide[used], np.uint16(END))
    order = suffix_order(text, length)
    starts = np.flatnonzero(common_prefixes(text, order, length) < length)
    windows = np.arange(strings.shape[1] - length + 1) < counts[:, None]
    holder = np.full(wide.shape, LAST_ID)
    holder[:, : windows.shape[1]] = np.where(windows, ids[:, None], LAST_ID)
    least = np.minimum.reduceat(np.append(holder[used], LAST_ID)[order], starts)
    found = np.empty(len(text), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(starts, len(text))))
    out = np.full(wide.shape, LAST_ID)
    out[used] = found[:-1]
    return out[:, : windows.shape[1]]


def may_share(strings: np.ndarray, counts: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """Which strings may hold a window of another one: there is another under their minimizer, and a window's hash occurs again."""
    _, number, size = np.unique(hashes, return_inverse=True, return_counts=True)
    rows, width = np.flatnonzero(size[number] > 1), strings.shape[1]
    found, inside = [], np.arange(width - length + 1)
    for a in range(0, len(rows), HASHED):
        part = rows[a : a + HASHED]
        flat = np.append(strings[part].ravel(), np.zeros(length - 1, strings.dtype))
        found.append(gram_hashes(flat, length).reshape(len(part), width)[:, : len(inside)][inside < counts[part][:, None]])
    out = np.zeros(len(strings), bool)
    if found:
        values = np.concatenate(found)
        ordered, seen = np.sort(values), np.zeros(1 << 24, bool)
        seen[(ordered[1:][ordered[1:] == ordered[:-1]] >> U64(40)).astype(np.int64)] = True
        out[np.repeat(rows, counts[rows])[seen[(values >> U64(40)).astype(np.int64)]]] = True
    return out


def byte_resolver(plan: Windows):
    def resolve(strings, counts, hashes, ids, places):
        # A window that no other string holds occurs first in its own; the others go through the transform.
        out = np.repeat(ids[:, None], plan.most, axis=1)
        order = np.flatnonzero(may_share(strings, counts, hashes, plan.length))
        order = order[np.argsort(hashes[order], kind="stable")]
        sizes = np.cumsum(counts[order] + plan.length)
        new = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
        a = 0
        while a < len(order):
            limit = (sizes[a - 1] if a else 0) + CHUNK_BYTES
            ends = np.append(new[new > a], len(order))
            fits = ends[sizes[ends - 1] <= limit]
            b = int(fits[-1]) if len(fits) else int(ends[0])
            part = order[a:b]
            out[part] = first_documents(strings[part], counts[part], ids[part], plan.length)
            a = b
        return out, np.zeros_like(out)

    return resolve


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_units (bytes), spans (removed stretches) and kept (the remaining bytes) for every row.

    A byte is removed if a string of `length` bytes over it also starts in a document with a smaller identifier. Nulls,
    empty texts, ties and repeated rows are treated as in `remove_repeats`.
    """
    plan = Windows.of(length, 16, words=False, strict=True)
    return remove_repeats(docs, plan, byte_resolver(plan), id_col, text_col)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over all documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (see `suffix_dedup`)."""
    return digests(suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")), "bytes")
