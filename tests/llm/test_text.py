"""Token files, BPE, token counts, classifiers, decontamination and the pipeline."""

import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import bpe, decontaminate, language, quality, token_counts, token_files, tokenize
from quarry.llm.common import scratch
from quarry.llm.tokenize import vocabulary_path

from . import brute
from .conftest import prose

WORD_BPE, BYTE_BPE = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_token_files(spark, odd_docs, odd_texts):
    tokenizer, start, expected = library(WORD_BPE), 0, {}
    for doc_id, text in odd_texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    out = scratch(spark, "test-tokens")
    rows = token_files.token_files(odd_docs, out, WORD_BPE, end_id=2, n_shards=3, shard_bytes=20_000).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.ids) for r in rows} == expected
    name = next(r.file for r in rows if r.doc_id == 13)
    file = token_files.open_token_file(f"{out}/files/{name}")
    assert file.ids(file.doc_ids.tolist().index(13)).tolist() == expected[13][3]


def test_token_files_find_damage(spark, odd_docs):
    out = scratch(spark, "test-tokens")
    token_files.token_files(odd_docs, out, WORD_BPE, n_shards=1).count()
    path = f"{out.removeprefix('file:')}/files/shard-0000000-00000.tokens"
    data = bytearray(open(path, "rb").read())
    file = token_files.TokenFile(lambda at, size: bytes(data[at : at + size]), len(data))
    place = int(file.begins[14] + file.sizes[14][0] // 2)
    data[place] ^= 0xFF
    file.ids(13)
    with pytest.raises(Exception):  # noqa: B017
        file.ids(14)
    assert struct.unpack("<I", data[-4:])[0] == token_files.SEEK_MAGIC


def test_token_files_edges(spark, no_docs, nameless):
    assert token_files.token_files(no_docs, scratch(spark, "test-tokens"), WORD_BPE).count() == 0
    rows = token_files.token_files(nameless, scratch(spark, "test-tokens"), WORD_BPE, end_id=2).collect()
    assert [(r.doc_id, r.n_tokens) for r in sorted(rows, key=lambda r: r.start)][:3] == [(None, 1), (None, 4), (None, 4)] and [r.doc_id for r in sorted(rows, key=lambda r: r.start)][3:] == [3, 4, 4, 4]
    least = -(1 << 63)
    rows = token_files.token_files(spark.createDataFrame([(least, "a"), (None, "b b")], "doc_id long, text string"), scratch(spark, "test-tokens"), WORD_BPE).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens) for r in rows) == [(str(least), 2, 1), ("None", 0, 2)]


def test_bpe(odd_docs, odd_texts, no_docs, nameless):
    tokenizer = library(WORD_BPE)
    rows = {r.doc_id: r for r in bpe.bpe_encode(odd_docs, WORD_BPE, decode=True).collect()}
    for doc_id, text in odd_texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert rows[doc_id].ids == ids and rows[doc_id].decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_encode(no_docs, WORD_BPE).count() == 0
    assert sorted((str(r.doc_id), len(r.ids)) for r in bpe.bpe_encode(nameless, WORD_BPE).collect()) == [("3", 0), ("4", 0), ("4", 3), ("4", 3), ("None", 0), ("None", 3), ("None", 3)]
    again = bpe.bpe_decode(bpe.bpe_encode(odd_docs, WORD_BPE, decode=True).withColumnRenamed("decoded", "before"), WORD_BPE)
    assert again.filter("before != decoded").count() == 0


def test_bpe_on_documents(spark, sf_dir):
    tokenizer = library(WORD_BPE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), WORD_BPE, decode=True).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_batched_merges_equal_single_ones():
    """Many words at once, of every length around a tree's sizes, beside one word at a time; a small cache changes nothing."""
    coder = bpe.bpe(WORD_BPE)
    words = [w.encode() for n in (1, 2, 3, 4, 5, 8, 9, 16, 17, 33, 64, 65, 66, 200) for w in ("ab" * n, "theinganer" * n, "é" * n, "zq" * n)]
    ids, counts = coder.words(words)
    for word, own in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        symbols = coder.inner[np.frombuffer(word, np.uint8)].tolist()
        symbols[-1] = int(coder.last[word[-1]])
        assert own.tolist() == bpe.merge(symbols, coder.ranks, coder.results)
    small = bpe.Bpe(WORD_BPE)
    small.KEPT = 1
    for text in ("one two three", "two  four", "one <|endoftext|>two", ""):
        assert small.encode([text]) == coder.encode([text])


def test_bpe_merges_leftmost_lowest():
    ranks = {1 << 20 | 1: 0, 2 << 20 | 1: 1, 3 << 20 | 2: 2}
    assert bpe.merge([1, 1, 1], dict(ranks), [2, 3, 4]) == [3]
    assert bpe.merge([1, 1, 1, 1], dict(ranks), [2, 3, 4]) == [2, 2]
    assert bpe.merge([7], {}, []) == [7] and bpe.merge([], {}, []) == []


def test_token_counts(spark, odd_docs, odd_texts, no_docs):
    tokenizer = library(BYTE_BPE)
    short = [(i, t) for i, t in odd_texts if len(t or "") < 5000]
    got = {}
    for r in token_counts.token_counts(odd_docs, BYTE_BPE).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.n_tokens)
    for doc_id, text in odd_texts:
        assert sum(n for _, _, n in got[doc_id].values()) == len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        ends = np.cumsum([len(line) + 1 for line in (text or "").split("\n")])
        lines = [(int(a), min(int(b), len(text or ""))) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        lines = [x for k, x in enumerate(lines) if x[0] < x[1] or k == 0]
        assert [x[:2] for _, x in sorted(got[doc_id].items())] == lines
        if (doc_id, text) in short:
            wanted = brute.attribute(tokenizer.encode(text or "", add_special_tokens=False).offsets, lines)
            assert {k: x[2] for k, x in got[doc_id].items() if x[2]} == dict(wanted), doc_id
    sections = [(i, k, a, b) for i, _ in short for k, (a, b) in enumerate([(0, 7), (5, 30), (40, 41), (60, 900)])] + [(1, None, 3, 4), (2, 9, None, 4)]
    table = spark.createDataFrame(sections, "doc_id long, section int, start long, end long")
    got = {}
    for r in token_counts.token_counts(odd_docs, BYTE_BPE, table).collect():
        got.setdefault(r.doc_id, {})[r.section] = r.n_tokens
    for doc_id, text in short:
        wanted = brute.attribute(tokenizer.encode(text or "", add_special_tokens=False).offsets, [(0, 7), (5, 30), (40, 41), (60, 900)])
        assert {k: n for k, n in got[doc_id].items() if n} == dict(wanted), doc_id
    assert token_counts.token_counts(no_docs, BYTE_BPE).count() == 0
    twice = spark.createDataFrame([(None, "one two\nthree"), (7, "one"), (7, "one")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.section, r.n_tokens) for r in token_counts.token_counts(twice, BYTE_BPE).collect()) == [("7", 0, 1), ("7", 0, 1), ("None", 0, 3), ("None", 1, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_attribution_of_any_sections(seed):
    """Nested, equal, overlapping, touching, empty and inverted sections, and tokens over several of them."""
    rng = random.Random(seed)
    for _ in range(300):
        n = rng.randrange(1, 40)
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(rng.randrange(12)))})
        tokens = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)] + [(a, a + 1) for a in range(min(n, 2))]
        sections = sorted((rng.randrange(n + 2), rng.randrange(n + 4)) for _ in range(rng.randrange(7)))
        if sections and rng.random() < 0.5:
            sections = sorted(sections + sections[:2])
        found = token_counts.attribute(np.array(tokens), np.array(sections, np.int64).reshape(-1, 2))
        assert [{k: 1} for k in found.tolist()] == [dict(brute.attribute([t], sections)) for t in tokens], (tokens, sections)


def test_token_counts_of_nested_sections(spark):
    """A section inside another does not take the tokens after it; bounds beyond a text are cut to it."""
    texts = [(1, prose(11, 30)), (2, "one two"), (3, prose(12, 20)), (4, None)]
    sections = [(i, k, a, b) for i in (1, 2, 4) for k, (a, b) in enumerate([(0, 10_000), (10, 20), (10, 20), (12, 14), (20, 26), (-5, 3)])]
    found = {}
    for r in token_counts.token_counts(spark.createDataFrame(texts, "doc_id long, text string"), BYTE_BPE, spark.createDataFrame(sections, "doc_id long, section int, start long, end long")).collect():
        found.setdefault(r.doc_id, {})[r.section] = r.n_tokens
    tokenizer = library(BYTE_BPE)
    for doc_id, text in texts:
        own = sorted((a, b, k) for i, k, a, b in sections if i == doc_id)
        wanted = brute.attribute(tokenizer.encode(text or "", add_special_tokens=False).offsets, [s[:2] for s in own])
        wanted = {own[k][2] if k >= 0 else -1: n for k, n in wanted.items()}
        assert {k: n for k, n in found[doc_id].items() if n} == wanted
    assert found[3] == {-1: sum(found[3].values())} and -1 not in found[1]


def odd_strings(seed, n):
    rng = random.Random(seed)
    bits = ["<|endoftext|>", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|endof", "text|>", " ", " ", "\n", "  ", "\t", "\x1c", "\u2028", "A", "b", "É", "İ", "é", "Don't", "'LL", "12", ".", "!?", "漢字", "\U0001f600", "<", "|>", "\0"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_encoders_equal_the_library():
    """Added tokens in any case, glued to words and marks; every encoder twice, with what it has kept."""
    texts = odd_strings(1, 4000) + [f"a{x}{t}{x}b" for t in ("<|EndOfText|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|endoftext|>") for x in ("", " ", ".", "\n")]
    word, byte = library(WORD_BPE), library(BYTE_BPE)
    ids, spans = tokenize.IdEncoder(WORD_BPE, "<u2"), tokenize.SpanEncoder(BYTE_BPE)
    for _ in range(2):
        for i in range(0, len(texts), 97):
            part = texts[i : i + 97]
            assert [np.frombuffer(d, "<u2").tolist() for d in ids.encode(part)] == [word.encode(t, add_special_tokens=False).ids for t in part]
            found, per_text = spans.spans(part)
            wanted = [[(a + base, b + base) for a, b in byte.encode(t, add_special_tokens=False).offsets] for t, base in zip(part, np.cumsum([0, *map(len, part[:-1])]).tolist(), strict=True)]
            assert per_text.tolist() == [len(w) for w in wanted] and [tuple(s) for s in found.tolist()] == [s for w in wanted for s in w]


def test_encoders_of_other_vocabularies(spark):
    """A vocabulary of the other kind is encoded whole, or refused, never wrongly."""
    texts = odd_strings(2, 500) + ["Hello  World\nNew line"]
    word, byte = library(WORD_BPE), library(BYTE_BPE)
    assert [np.frombuffer(d, "<u2").tolist() for d in tokenize.IdEncoder(BYTE_BPE, "<u2").encode(texts)] == [byte.encode(t, add_special_tokens=False).ids for t in texts]
    _, per_text = tokenize.SpanEncoder(WORD_BPE).spans(texts)
    assert per_text.tolist() == [len(word.encode(t, add_special_tokens=False).ids) for t in texts]
    rows = token_files.token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scratch(spark, "test-tokens"), BYTE_BPE).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: byte.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    with pytest.raises(ValueError, match="word ends"):
        bpe.Bpe(BYTE_BPE)


def test_token_files_that_vanish(spark, odd_docs, monkeypatch):
    """Files written where Spark does not read raise an error; paths get the scheme that Spark takes them for."""
    assert token_files.qualified(spark, "/tmp/x").startswith("file:")
    real = token_files.write_token_files
    monkeypatch.setattr(token_files, "write_token_files", lambda docs, out, *a, **k: real(docs, out + "-elsewhere", *a, **k))
    with pytest.raises(RuntimeError, match="cannot be read"):
        token_files.token_files(odd_docs, scratch(spark, "test-tokens"), WORD_BPE)


def test_decontaminate(spark, odd_docs, odd_texts, no_docs, sf_dir):
    items = [(1, " ".join(odd_texts[10][1].split(" ")[5:40])), (2, "Two words"), (3, None), (4, "..."), (10, "WORD"), (5, odd_texts[12][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 100):
        rows = decontaminate.contamination(decontaminate.decontaminate(odd_docs, table, block_bytes=block)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == brute.contamination(odd_texts, items)
    assert decontaminate.decontaminate(no_docs, table).count() == 0
    assert decontaminate.contamination(decontaminate.decontaminate(odd_docs, table.limit(0))).filter("contaminated").count() == 0
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.op3_decontaminate(spark, sf_dir).collect()}
    assert got == brute.contamination(docs, items)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 10])
def test_decontaminate_keeps_rows(spark, block):
    """Rows with null and repeated doc_ids stay rows of their own, with one block of the benchmark and with several."""
    docs = [(None, "red fox runs"), (None, "a blue bird"), (None, None), (7, "red fox"), (7, "no match in these words"), (7, "red fox and blue bird"), (7, "red fox"), (8, "")]
    items = spark.createDataFrame([(1, "red fox"), (2, "blue bird"), (3, "green frog"), (4, "old grey owl")], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = decontaminate.contamination(decontaminate.decontaminate(table, items, block_bytes=block)).collect()
    wanted = [(None, 3, 2, 1), (None, 3, 2, 1), (None, 0, 0, 0), (7, 2, 2, 1), (7, 5, 0, 0), (7, 5, 4, 2), (7, 2, 2, 1), (8, 0, 0, 0)]
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in rows))) == sorted(map(str, wanted))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red big fox"), (2, "red fox"), (3, "red one two fox")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red fox")], "item_id long, text string")
    exact = {r.doc_id for r in decontaminate.decontaminate(docs, items).filter(F.size("spans") > 0).collect()}
    near = {r.doc_id for r in decontaminate.decontaminate(docs, items, slop=1).filter(F.size("spans") > 0).collect()}
    assert exact == {2} and near == {1, 2}


def test_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = quality.op2_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark, odd_docs, no_docs, nameless):
    model = quality.fit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.score for r in quality.classify(nameless, model).collect()] == [0.5] * 7
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 22)] + [(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    assert quality.classify(odd_docs, quality.fit(odd_docs, some)).count() == 21 and quality.classify(no_docs, model).count() == 0


@pytest.mark.parametrize(("n_bad", "words"), [(12, 30), (1, 30), (2, 1)])
def test_quality_learns_from_few(spark, n_bad, words):
    """Fewer than 20 pieces of a label still tell the labels apart, also where their texts are short."""
    bad = lambda seed, n: " ".join(f"{(seed * 7 + k) % 10}#{(seed + k * 3) % 10}" for k in range(n))
    rows = [(k, prose(k, 30), 1) for k in range(40)] + [(100 + k, bad(k, words), 0) for k in range(n_bad)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    new = spark.createDataFrame([(1, prose(900, 30)), (2, bad(77, 30))], "doc_id long, text string")
    good, poor = [r.score for r in quality.classify(new, quality.fit(docs, labels)).orderBy("doc_id").collect()]
    assert good > poor


def test_language_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = language.op7_language(spark, sf_dir).join(truth, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_language_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores = []
    for parts in (1, 7):
        rows = language.identify(docs, language.fit(docs.repartition(parts, "text"), most_docs=60)).collect()
        scores.append({r.doc_id: (r.lang_pred, r.score) for r in rows})
    assert scores[0] == scores[1]


def test_quality_does_not_depend_on_partitions(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    models = [quality.fit(docs.repartition(parts, "text"), labels, most_pieces=500) for parts in (1, 7)]
    assert models[0] == models[1]


def test_language_edges(spark, odd_docs, no_docs):
    model = language.fit(no_docs)
    assert {r.lang_pred for r in language.identify(odd_docs, model).collect()} == {"und"} and language.identify(no_docs, model).count() == 0
    known = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    model = language.fit(known)
    told = language.identify(spark.createDataFrame([(1, "the dog"), (2, "die Katze"), (3, None), (4, "12 !")], "doc_id long, text string"), model)
    assert [r.lang_pred for r in told.orderBy("doc_id").collect()] == ["en", "de", "und", "und"]
    odd = language.identify(spark.createDataFrame([(None, "the dog"), (5, "die Katze"), (5, "")], "doc_id long, text string"), model)
    assert sorted((str(r.doc_id), r.lang_pred) for r in odd.collect()) == [("5", "de"), ("5", "und"), ("None", "en")]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, sf_dir)
    assert good.columns == docs.columns
    single = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    folded = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()}
    assert single.columns == docs.columns and single.count() == len(folded)
    near = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    classes = brute.jaccard([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for c, _ in classes.values()})
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    wanted = [d for d, r in brute.contamination([(r.doc_id, r.text) for r in docs.collect()], items).items() if not r[4]]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(wanted)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= docs.count()


def test_pipeline_edges(spark, odd_docs, no_docs, nameless, sf_dir):
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, no_docs, sf_dir).count() == 0
        apply(spark, odd_docs, sf_dir).collect()
    assert corpus_pipeline.drop_copies(spark, nameless, sf_dir).count() == 2
    assert corpus_pipeline.drop_contaminated(spark, nameless, sf_dir).count() == 7
    # Rows that share document 4 are known by it; those without identifier are copies of its text; null and empty texts have no words.
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_copies(spark, nameless, sf_dir).collect()) == ["3", "4", "4", "4", "None"]
    assert corpus_pipeline.encode(spark, nameless, sf_dir).count() == 7 and corpus_pipeline.keep_good(spark, nameless, sf_dir).count() <= 7
