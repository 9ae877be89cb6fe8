"""Similarity self-join of documents on sets of word n-grams: MinHash bands find candidates, full sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, LOWER, U64, bound_batches, join_by_key, mix, only, slices, stage, utf8, word_hashes, words
from .components import components
from .repeats import gram_hashes

N_GRAM, THRESHOLD = 5, 0.8
TARGET_RECALL, MOST_HASHES = 0.9999, 128
#: Bytes of gram sets, and documents, in one part of a candidate cluster: pairs are verified by pairs of parts.
PART_BYTES, PART_DOCS = 2 << 20, 1024
#: Rows of cluster assignments and pairs of parts that are broadcast at most (some 60 bytes each); beyond it they are joined by a shuffle.
MOST_BROADCAST = 200_000
SLICE_BYTES = 1 << 20


def banding(threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows with the most rows (fewest false candidates) whose chance to miss a pair at the threshold is at most 1 - target_recall."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best or (most, 1)


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every text one after another, ascending in each, and how many each has.

    Words are runs of 0-9, a-z and characters beyond ASCII, after A-Z are lower-cased. A text of fewer than n words, but not none, has one gram: all its words.
    """
    low = LOWER[flat]
    starts, ends, owner = words(low, offsets, ALNUM_WORD)
    hashes = word_hashes(low, starts, ends, ALNUM_WORD)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    grams, of = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(hashes) >= n:
        grams = gram_hashes(hashes, n)
        whole = owner[: len(grams)] == owner[n - 1 :]
        grams, of = grams[whole], owner[: len(grams)][whole]
    few = np.flatnonzero((counts > 0) & (counts < n))
    begins = np.cumsum(counts) - counts
    single = np.array([int(gram_hashes(hashes[begins[k] : begins[k] + counts[k]], int(counts[k]))[0]) ^ int(counts[k]) for k in few], U64)
    grams, of = mix(np.concatenate((grams, single))), np.concatenate((of, few))
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1]))) if len(grams) else np.zeros(0, bool)
    return grams[new], np.bincount(of[new], minlength=len(offsets) - 1)


def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def band_hashes(grams: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """texts x bands: hashes of the band's minima; texts without grams have zeros."""
    out = np.zeros((len(sizes), bands), U64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    starts = (np.cumsum(sizes) - sizes)[some]
    x, (a, b) = (grams >> U64(32)).astype(np.uint32), coefficients(bands * rows)
    for band in range(bands):
        h = np.full(len(some), U64(band + 1))
        for k in range(band * rows, (band + 1) * rows):
            h = mix(h * U64(0x9FB21C651E98DF25) + np.minimum.reduceat(x * a[k] + b[k], starts).astype(U64))
        out[some, band] = h
    return out


def digests_of(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed grams for each set: together a digest of 128 bits."""
    sums, ends = [np.concatenate((np.zeros(1, U64), np.cumsum(g, dtype=U64))) for g in (grams, mix(grams ^ U64(0xA5A5A5A5A5A5A5A5)))], np.cumsum(sizes)
    low, high = (s[ends] - s[ends - sizes] for s in sums)
    return low, high


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key, n_grams, set_low and set_high (a 128-bit digest of the gram set) and the band hashes of rows (doc_id, text, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                grams, sizes = shingle_sets(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                low, high = digests_of(grams, sizes)
                hashes = band_hashes(grams, sizes, bands, rows)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(hashes.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64())),
                ], ["doc_id", "key", "n_grams", "set_low", "set_high", "bands"])

    return docs.mapInArrow(run, "doc_id long, key long, n_grams long, set_low long, set_high long, bands array<long>")


def gram_rows(docs: DataFrame, n: int) -> DataFrame:
    """node, cluster, part, pairs, copies, grams (ascending 64-bit hashes) of the documents to verify.

    Rows whose text has another set than their node (rows that share an identifier) are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(0))
            for i, j in slices(offsets, SLICE_BYTES):
                grams, sizes = shingle_sets(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                low, high = digests_of(grams, sizes)
                own = batch.slice(i, j - i)
                same = (low.view(np.int64) == own.column(1).to_numpy()) & (high.view(np.int64) == own.column(2).to_numpy())
                ends = np.cumsum(sizes)
                data = [grams[e - s : e].tobytes() for s, e in zip(sizes[same], ends[same], strict=True)]
                kept = own.filter(pa.array(same))
                yield pa.RecordBatch.from_arrays([*kept.columns[3:8], pa.array(data, pa.binary())], ["node", "cluster", "part", "pairs", "copies", "grams"])

    rows = docs.select("text", "set_low", "set_high", "node", "cluster", "part", "pairs", "copies")
    return rows.mapInArrow(run, "node long, cluster long, part long, pairs array<struct<low:bigint,high:bigint>>, copies long, grams binary")


def shared_grams(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Grams that each of `rows` shares with each of `columns`, by products of presence matrices over stretches of the grams."""
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate(([True], grams[1:] != grams[:-1]))
    number = np.cumsum(new) - 1
    common = (np.bincount(number) > 1)[number]
    number, owner = number[common], owner[common]
    number = np.cumsum(np.concatenate(([0], (number[1:] != number[:-1]).astype(np.int64)))) if len(number) else number
    total = np.zeros((len(rows), len(columns)), np.float32)
    width = max(256, (4 << 20) // max(1, len(sets)))
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        s = slice(*np.searchsorted(number, (a, a + width)))
        present = np.zeros((len(sets), min(width, int(number[-1]) + 1 - a)), np.float32)
        present[owner[s], number[s] - a] = 1
        total += present[rows] @ present[columns].T
    return total


def groups_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes, from links between a and b."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def verify(threshold: float):
    """Rows node, links (copies of linked documents in this pair of parts) and least (of the linked group within it)."""

    def flush(rows: list[dict]) -> pa.RecordBatch | None:
        first, second = rows[0]["low"], rows[0]["high"]
        rows = list({r["node"]: r for r in rows}.values())
        part, node, copies = (np.array([r[c] for r in rows], np.int64) for c in ("part", "node", "copies"))
        sets = [np.frombuffer(r["grams"], U64) for r in rows]
        sizes = np.array([len(s) for s in sets], np.float64)
        a, b = np.flatnonzero(part == first), np.flatnonzero(part == second)
        if not len(a) or not len(b):
            return None
        both = shared_grams(sets, a, b)
        x, y = np.nonzero(both * (1 + threshold) >= threshold * (sizes[a][:, None] + sizes[b][None, :]) - 1e-9)
        x, y = a[x], b[y]
        keep = x < y if first == second else x != y
        x, y = x[keep], y[keep]
        if not len(x):
            return None
        links = np.bincount(x, copies[y], len(rows)) + np.bincount(y, copies[x], len(rows))
        order = np.argsort(node, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        least = node[order][groups_of(len(rows), place[x], place[y])][place]
        some = np.unique(np.concatenate((x, y)))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(least[some])], ["node", "links", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["cluster"], row["low"], row["high"])
                if key != last and held:
                    if (out := flush(held)) is not None:
                        yield out
                    held = []
                last = key
                held.append(row)
        if held and (out := flush(held)) is not None:
            yield out

    return run


def parts(sized: DataFrame) -> DataFrame:
    """node, cluster, copies, part and pairs: the pairs of parts in which a node's links are looked for.

    sized has node, cluster, copies, n_grams and bands. A cluster of one part's size is one part. A larger one is cut by the
    least band hash, which near copies share, and groups of one least hash that are too large by themselves by a hash of the
    node. Two parts are paired only where a band has members in both.
    """
    sized = sized.withColumn("least", F.array_min("bands"))
    room = lambda grams, docs: F.greatest(F.ceil(F.sum(grams) * 8 / F.lit(PART_BYTES)), F.ceil(F.sum(docs) / F.lit(PART_DOCS)))
    groups = sized.groupBy("cluster", "least").agg(F.sum("n_grams").alias("grams"), F.count("*").alias("docs"), room("n_grams", F.lit(1)).alias("own"))
    groups = stage(groups, "parts")
    whole = groups.groupBy("cluster").agg(room("grams", "docs").alias("room"), F.count("*").alias("size"))
    groups = stage(join_by_key(groups, whole, ["cluster"], groups.count(), "size").drop("size", "grams"), "parts")
    near = F.when(F.col("own") > 1, F.xxhash64("least", F.pmod(F.xxhash64("node"), F.col("own")))).otherwise(F.pmod(F.xxhash64("least"), F.col("room")))
    out = join_by_key(sized, groups, ["cluster", "least"], sized.count(), "docs").withColumn("part", F.when(F.col("room") > 1, near).otherwise(0).cast("long"))
    out = stage(out.select("node", "cluster", "copies", "bands", "part", (F.col("room") > 1).alias("cut")), "parts")
    banded = out.filter("cut").select("cluster", "part", F.explode("bands").alias("band")).distinct()
    other = banded.select("cluster", "band", F.col("part").alias("high"))
    both = banded.withColumnRenamed("part", "low").join(other, ["cluster", "band"]).filter("low <= high").select("cluster", "low", "high").distinct()
    ends = F.explode(F.array_distinct(F.array("low", "high"))).alias("part")
    pairs = both.select("cluster", ends, F.struct("low", "high").alias("pair")).groupBy("cluster", "part").agg(F.collect_list("pair").alias("pairs"))
    single = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))
    return out.drop("bands").join(pairs, ["cluster", "part"], "left").withColumn("pairs", F.coalesce("pairs", single)).drop("cut")


def jaccard_join(docs: DataFrame, n: int = N_GRAM, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_grams, copy_of.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is at least the threshold; a class is a
    connected component of links, and class_id its least identifier. n_links counts the other rows linked to a row, among
    them rows with the same set. copy_of is the least identifier with the same set; each set is banded once.
    Texts without words (null, empty) have no grams and no links, and are classes of their own.
    Rows are compared by their texts, also where identifiers are null or repeat; class_id and copy_of are null where no
    member of the class, or no row with the set, has an identifier. Further columns are ignored.

    Bands and rows are chosen so that a pair at the threshold is missed with a chance of at most 1 - target_recall. Documents
    that share a band are put into clusters (by minima of buckets, never by pairs), and the pairs of a cluster are verified on
    full sets in pairs of `parts`; a task emits a row per document, not per pair.
    """
    bands, rows = banding(threshold, target_recall)
    # A row without identifier is found again by a hash of its text.
    docs = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("key"))
    bound_batches(docs.sparkSession)
    signed = stage(signatures(docs, n, bands, rows), "signatures")
    of_set = ["set_low", "set_high", "n_grams"]
    sets = signed.filter("n_grams > 0").groupBy(*of_set).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"), F.count("*").alias("copies"), F.min("bands").alias("bands"))
    sets = sets.select(*of_set, F.col("first.doc_id").alias("rep"), F.col("first.key").alias("key"), "copies", "bands")
    sets = stage(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    n_sets = sets.count()
    banded = sets.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("size")).filter("least != most").select("band", "least", "size")
    edges = join_by_key(banded, buckets, ["band"], n_sets * bands, "size").filter("node != least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    clusters = components(edges).select("node", F.col("label").alias("cluster"))
    sized = stage(clusters.join(sets.select("node", "copies", "n_grams", "bands"), "node"), "clusters")
    chosen = parts(sized).join(sets.select("node", "key", "set_low", "set_high"), "node")
    chosen = stage(chosen.join(signed.groupBy("key").count().filter("count > 1").select("key", F.lit(True).alias("again")), "key", "left"), "candidates")
    text = docs.select("key", "text")
    size = chosen.agg(F.count("*") + F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0]
    some = F.broadcast if size <= MOST_BROADCAST else lambda rows: rows
    grams = gram_rows(text.join(some(chosen.filter("again IS NULL")), "key"), n)
    if not chosen.filter("again").isEmpty():
        grams = grams.unionByName(gram_rows(text.join(some(chosen.filter("again")), "key").dropDuplicates(["node", "text"]), n))
    paired = grams.select("cluster", F.explode("pairs").alias("pair"), "part", "node", "copies", "grams").select("cluster", "pair.low", "pair.high", "part", "node", "copies", "grams")
    paired = paired.repartition(F.col("cluster"), F.col("low"), F.col("high")).sortWithinPartitions("cluster", "low", "high", "node")
    found = stage(paired.mapInArrow(verify(threshold), "node long, links long, least long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("u"), F.col("least").alias("v"))).join(sets.select("node", "rep"), "node")
    classes = stage(classes, "classes")
    least = classes.groupBy("label").agg(F.min("rep").alias("class_id"), F.count("*").alias("size"))
    classes = join_by_key(classes, least, ["label"], classes.count(), "size").select("node", "class_id", F.lit(True).alias("linked"))
    known = stage(sets.select(*of_set, "node", "rep", "copies").join(links, "node", "left").join(classes, "node", "left"), "known")
    signed = signed.drop("bands", "key")
    out = join_by_key(signed.filter("n_grams > 0"), known, of_set, signed.count(), "copies")
    out = out.unionByName(signed.filter("n_grams = 0"), allowMissingColumns=True)
    return out.select(
        "doc_id", F.when(F.col("linked"), F.col("class_id")).when(F.col("node").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), "n_grams", F.when(F.col("node").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")).alias("copy_of"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over all documents: doc_id, class_id, n_links, n_grams, copy_of (see `jaccard_join`)."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
