"""Exact, near, substring and suffix deduplication against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from quarry.llm import components, decontaminate, exact_dedup, jaccard_join, repeats, substring_dedup, suffix_dedup
from quarry.llm.common import join_by_key, scratch
from quarry.llm.repeats import Windows, digests
from tests.harness import differences

from . import brute
from .conftest import prose


def test_exact_dedup_equals_sql(spark, sf_dir):
    assert differences(exact_dedup.op8_exact_dedup(spark, sf_dir), sf_dir, exact_dedup.OP8_SQL) is None


def test_exact_dedup_edges(odd_docs, nameless, no_docs):
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(odd_docs).collect()}
    assert rows[2].keep_id == 1 and not rows[2].kept and rows[3].keep_id == 1 and rows[1].group_size == 3
    assert rows[5].group_size == 2 and rows[5].kept and rows[6].keep_id == 5 and rows[7].group_size == 1
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    odd = exact_dedup.exact_dedup(nameless).collect()
    assert sorted((r.group_size, r.kept) for r in odd) == [(3, False), (3, False), (3, True), (4, False), (4, False), (4, False), (4, True)]
    assert {r.keep_id for r in odd} == {3, 4}


def test_exact_dedup_compares_bytes_under_equal_digests(odd_docs):
    """With a digest of one character different texts collide; they must still be kept apart."""
    plain = {tuple(r)[:5] for r in exact_dedup.exact_dedup(odd_docs).collect()}
    assert {tuple(r)[:5] for r in exact_dedup.exact_dedup(odd_docs, digest_of=lambda t: F.substring(F.sha2(t, 256), 1, 1)).collect()} == plain


def test_exact_dedup_goes_on_with_its_store(spark):
    """A copy in a later batch finds its original, a restart of the stream reads nothing twice, and locators lead to the bytes."""
    store, schema = scratch(spark, "test-store"), "doc_id long, text string"
    exact_dedup.exact_dedup(spark.createDataFrame([(5, "a  b"), (6, "c"), (None, "d")], schema), store=store).collect()
    rows = exact_dedup.exact_dedup(spark.createDataFrame([(7, "a b"), (3, "c"), (9, "new"), (8, "d"), (6, "c")], schema), store=store)
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.keep_id, r.group_size, r.kept) for r in rows.collect())
    assert got == [(3, 3, 3, True), (5, 5, 2, True), (6, 3, 3, False), (6, 3, 3, False), (7, 5, 2, False), (8, 8, 2, True), (9, 9, 1, True), (99, 8, 2, False)]
    again = exact_dedup.exact_dedup(spark.createDataFrame([], schema), store=store)
    assert sorted(r.group_size for r in again.collect()) == sorted(g[2] for g in got)
    bodies = {(r.locator.file, r.locator.row): r.body for r in exact_dedup.located(spark.read.parquet(f"{store}/log")).collect()}
    assert {bodies[r.keep_locator.file, r.keep_locator.row] for r in rows.collect()} == {"a b", "c", "d", "new"}


def test_among_keeps_all_keys(spark):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id")
    keys = rows.filter("id % 7 = 0").select("k")
    kept = {r.id for r in exact_dedup.among(rows, keys, "k").collect()}
    assert kept >= set(range(0, 20_000, 7)) and len(kept) < 2900 and exact_dedup.among(rows, keys.limit(0), "k").count() == 0


def test_jaccard_join(spark, odd_docs, odd_texts, no_docs, nameless):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(odd_docs).collect()}
    assert got == brute.jaccard(odd_texts)
    assert jaccard_join.jaccard_join(no_docs).count() == 0
    rows = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_join.jaccard_join(nameless).collect())
    assert rows == [("3", "3", 0), ("4", "4", 0), ("4", "4", 3), ("4", "4", 3), ("None", "4", 3), ("None", "4", 3), ("None", "None", 0)]


def test_jaccard_join_without_identifiers(spark):
    """Texts are compared whether or not they have an identifier of their own."""
    base = prose(40, 100)
    rows = [(None, base + " x"), (None, base + " y"), (None, prose(41, 80)), (1, prose(42, 80)), (1, base + " z"), (2, prose(43, 60)), (2, prose(43, 60).upper())]
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("None", "1", 2), ("None", "1", 2), ("None", "None", 0), ("1", "1", 0), ("1", "1", 2), ("2", "2", 1), ("2", "2", 1)])


def test_jaccard_join_in_parts(spark, monkeypatch):
    """Clusters of several parts, cut by band hashes and by nodes, find the same links as one part does."""
    monkeypatch.setattr(jaccard_join, "PART_DOCS", 7)
    base, texts = prose(50, 60).split(" "), []
    for i in range(90):
        words = list(base)
        words[(i * 7) % 55] = f"edit{i % 11}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()} == brute.jaccard(texts)


def long_words():
    """Words that differ only in bytes 65,536 places apart, in texts that repeat nothing else."""
    a, b = "x" + "m" * 65_535 + "y" + "t" * 4000, "y" + "m" * 65_535 + "x" + "t" * 4000
    return a, b


def test_long_words_stay_apart(spark):
    a, b = long_words()
    head, tail = prose(60, 10), prose(61, 9)
    rows = [(1, f"{head} {a} {tail}"), (2, f"{head} {b} {tail}"), (3, f"{head} {b} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in digests(substring_dedup.substring_dedup(docs), "words").collect()}
    assert got == brute.spaced_repeats(rows) and [got[k][1] for k in (1, 2, 3)] == [0, 0, 20]
    single = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in jaccard_join.jaccard_join(single).collect()} == {1: 1, 2: 2}
    hits = decontaminate.decontaminate(docs, spark.createDataFrame([(7, a)], "item_id long, text string")).collect()
    assert {r.doc_id: len(r.spans) for r in hits} == {1: 1, 2: 0, 3: 0}


def test_jaccard_join_large_group(spark):
    """More near copies of one text than fit in a block of pairs, beside others."""
    base = prose(9, 120).split(" ")
    texts = [(i, " ".join(base[:-1] + [f"tail{i % 300}"])) for i in range(400)] + [(1000 + i, prose(100 + i, 60)) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()} == brute.jaccard(texts)


def test_jaccard_join_on_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.op6_jaccard_join(spark, sf_dir).collect()} == brute.jaccard(docs)


def test_banding_meets_the_target():
    bands, rows = jaccard_join.banding()
    assert (1 - 0.8**rows) ** bands <= 1 - jaccard_join.TARGET_RECALL and bands * rows <= jaccard_join.MOST_HASHES


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(200, 201), (201, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 5 for k in range(5, 60)}, 200: 200, 201: 200}


def test_join_by_key_splits_hot_keys(spark):
    rows = spark.range(30_000).select((F.when(F.col("id") < 20_000, 0).otherwise(F.col("id"))).alias("k"))
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = join_by_key(rows, per_key, ["k"], 30_000, "n")
    assert joined.count() == 30_000 and joined.filter("k = 0 AND n = 20000").count() == 20_000


def windows_of(texts, length):
    """Of every word window its places (document, place) in order."""
    found = {}
    for doc_id, text in texts:
        words = brute.SPACED.findall(text)
        for i in range(len(words) - length + 1):
            found.setdefault(tuple(words[i : i + length]), []).append((doc_id, i))
    return found


def test_paths_are_glued_across_buckets(spark, monkeypatch):
    """Windows of a long passage lie in many buckets; they make one path with one source, and without the glue they make many."""
    passage, length = prose(70, 400), 20
    texts = [(1, prose(71, 50) + " " + passage + " " + prose(72, 30)), (2, prose(73, 40) + " " + passage), (3, passage + " " + prose(74, 20))]
    docs, plan = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), Windows.of(length, 5, words=True, strict=False)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 200)
    spread = repeats.Spread.of(docs, plan, "doc_id", "text")
    edges = spread.exchange(spread.marked().mapInArrow(substring_dedup.send_edges(plan, spread.n), substring_dedup.EDGE_SCHEMA))
    paths = edges.mapInArrow(substring_dedup.resolve_edges(plan), substring_dedup.GRAPH_SCHEMA).filter("kind = 0")
    rows, whole = paths.collect(), substring_dedup.glued(paths).collect()
    wanted = windows_of(texts, length)
    assert len(rows) > 5 and len(whole) == len(rows) and sum(r.length for r in rows) == sum(len(p) > 1 for p in wanted.values())
    assert {(r.source_id, r.source_place - r.source_unit) for r in whole} == {(1, 0)}
    spans = digests(substring_dedup.substring_dedup(docs, length), "words").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in spans} == brute.spaced_repeats(texts, length) and {r.n_spans for r in spans} == {0, 1}


def test_compaction_stops_at_branches():
    """Edges 1-2-3 follow one another always; 4 and 5 both follow 3, and 4 ends a document."""
    own = np.array([1, 2, 3, 4, 5], np.uint64)
    head, distance = substring_dedup.compacted(own, np.array([0, 1, 2, 3, 3], np.uint64), np.array([2, 3, 0, 0, 0], np.uint64))
    assert head.tolist() == [0, 0, 0, 3, 4] and distance.tolist() == [0, 1, 2, 0, 0]
    assert substring_dedup.compacted(own[:0], own[:0], own[:0])[0].tolist() == []


def test_spans_are_verified_on_words(spark, monkeypatch):
    """Where hashes take different words for equal ones, the words at the source tell them apart."""
    real = repeats.word_hashes
    monkeypatch.setattr(repeats, "word_hashes", lambda *a: real(*a) >> np.uint64(63) | np.uint64(1))
    plan = Windows.of(20, 5, words=True, strict=False)
    rows = [{"block": 1, "doc_ids": np.array([1, 2]).tobytes(), "missing": b"\0", "ends": np.array([0, len(t), 2 * len(t)]).tobytes(), "text": zstandard.compress(t + u)} for t, u in [(prose(75, 40).encode(), prose(75, 40).encode())]]
    block = repeats.Block.of(rows[0], plan)
    good, bad = substring_dedup.words_digest(block, 0, 40), substring_dedup.words_digest(block, 1, 40)
    spans = np.array([[40, 21, 0], [41, 20, 0]], np.uint32)
    row = rows[0] | {"replies": [{"block": 5, "spans": spans.tobytes(), "digests": good + bad}]}
    out = list(substring_dedup.differing(plan)([pa.RecordBatch.from_pylist([row])]))
    assert [b.to_pylist() for b in out] == [[{"block": 5, "first": 41}]]


@pytest.mark.parametrize("hot", [0, 1])
def test_hot_minimizers_are_split(spark, monkeypatch, odd_docs, odd_texts, hot):
    """Minimizers met in more than so many blocks are sent window by window; nothing changes."""
    monkeypatch.setattr(repeats, "HOT_BLOCKS", hot)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1000)
    plan_rows = digests(substring_dedup.substring_dedup(odd_docs), "words").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in plan_rows} == brute.spaced_repeats(odd_texts)
    rows = digests(suffix_dedup.suffix_dedup(odd_docs), "bytes").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute.byte_repeats(odd_texts)


@pytest.mark.parametrize("length", [20, 5])
def test_substring_dedup(odd_docs, odd_texts, length):
    rows = digests(substring_dedup.substring_dedup(odd_docs, length), "words").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute.spaced_repeats(odd_texts, length)


@pytest.mark.parametrize("length", [50, 12])
def test_suffix_dedup(odd_docs, odd_texts, length):
    rows = digests(suffix_dedup.suffix_dedup(odd_docs, length), "bytes").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute.byte_repeats(odd_texts, length)


def test_long_windows(odd_docs, odd_texts):
    """Windows of more units than a mask has bits, with short grams."""
    rows = digests(substring_dedup.substring_dedup(odd_docs, 100), "words").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute.spaced_repeats(odd_texts, 100)
    rows = digests(suffix_dedup.suffix_dedup(odd_docs, 100), "bytes").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute.byte_repeats(odd_texts, 100)
    with pytest.raises(ValueError, match="64 bits"):
        Windows(100, 5, words=True, strict=False)


def test_repeats_on_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op4_substring_dedup(spark, sf_dir).collect()} == brute.spaced_repeats(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op9_suffix_dedup(spark, sf_dir).collect()} == brute.byte_repeats(docs)


def test_repeats_edges(no_docs, nameless):
    assert substring_dedup.substring_dedup(no_docs).count() == 0 and suffix_dedup.suffix_dedup(no_docs).count() == 0
    for rows in (substring_dedup.substring_dedup(nameless, 2), suffix_dedup.suffix_dedup(nameless, 8)):
        got = sorted((str(r.doc_id), r.n_units, sum(s.end - s.start for s in r.spans)) for r in rows.collect())
        whole = max(n for _, n, _ in got)
        # The two rows of document 4 stay; those without identifier come later and are copies of them.
        assert got == sorted([("4", whole, 0), ("4", whole, 0), ("4", 0, 0), ("3", 0, 0), ("None", whole, whole), ("None", whole, whole), ("None", 0, 0)])


def test_repeats_of_the_last_identifier(spark):
    """The largest identifier is one, not a missing one."""
    docs = spark.createDataFrame([((1 << 63) - 1, "a b c d"), (None, "x y"), (-(1 << 63), "a b c d")], "doc_id long, text string")
    got = {r.doc_id: len(r.spans) for r in substring_dedup.substring_dedup(docs, 3).collect()}
    assert got == {(1 << 63) - 1: 1, None: 0, -(1 << 63): 0}


def test_answers_travel_together():
    """There are as many entries as blocks times buckets: they are not handed on one by one, and keep their order and contents."""
    n = 3 * repeats.ENTRIES
    rows = [(k, block, b"abcde", b"\0", b"", b"") for k in range(n // 3) for block in range(3)]
    batch = repeats.table(rows, repeats.MARK_SCHEMA)
    found = list(repeats.mark(2)(iter([batch])))
    assert len(found) == 3
    answers = [tuple(r.values()) for b in found for r in b.to_pylist()]
    assert answers == [(k, block, b"\x80", b"\x80", b"") for k in range(n // 3) for block in range(3)]


def test_strings_that_share_no_window_are_not_transformed():
    """All strings with a window of another one under their minimizer stay; those alone, or with no window that occurs again, go."""
    rng, length = np.random.default_rng(5), 50
    plan = Windows.of(length, 16, words=False, strict=True)
    strings = rng.integers(97, 123, (3000, plan.reach), np.uint8)
    counts = rng.integers(1, plan.most + 1, len(strings))
    hashes = np.arange(len(strings), dtype=np.uint64) // np.uint64(2)
    shared = np.arange(0, 1000, 20)
    strings[shared + 1, :length] = strings[shared, :length]
    strings[np.arange(plan.reach) >= (counts + length - 1)[:, None]] = 0
    may = suffix_dedup.may_share(strings, counts, hashes, length)
    assert may[shared].all() and may[shared + 1].all() and may.sum() < 2 * len(shared) + 10
    ids = rng.permutation(len(strings)).astype(np.int64)
    first, _ = suffix_dedup.byte_resolver(plan)(strings, counts, hashes, ids, np.zeros(len(strings), np.int64))
    windows = {(k, o): strings[k, o : o + length].tobytes() for k in range(len(strings)) for o in range(counts[k])}
    least = {}
    for (k, _), window in windows.items():
        least[window] = min(least.get(window, ids[k]), ids[k])
    assert len(windows) - len(least) >= len(shared) and all(first[at] == least[window] for at, window in windows.items())
    assert not suffix_dedup.may_share(strings[:1], counts[:1], hashes[:1], length).any()
