"""Alignment of two tokenizers against whole-text encoding and plain loops."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import alignment as al
from quarry.llm.tokenize import vocabulary_path

from .conftest import prose

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


def byte_values(tokenizer):
    """Bytes of each entry of the byte-level vocabulary, the letters numbered as its authors number them."""
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of, k = {chr(b): b for b in letters}, 0
    for b in range(256):
        if b not in letters:
            of[chr(256 + k)] = b
            k += 1
    return {i: bytes(of[c] for c in piece) for piece, i in tokenizer.get_vocab().items()}


def plain(texts):
    """Per text n_a, n_b, n_groups, n_links, n_best, count_sum, sha; and the links of each id pair."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a.no_truncation()
    values, rows, counts = byte_values(a), [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [values[i] for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        groups, links, i, j = [], [], 0, 0
        while i < len(ids_a):
            own_a, own_b, end_a, end_b = [ids_a[i]], [ids_b[j]], len(bytes_a[i]), len(bytes_b[j])
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    own_a.append(ids_a[i])
                    end_a, i = end_a + len(bytes_a[i]), i + 1
                else:
                    own_b.append(ids_b[j])
                    end_b, j = end_b + len(bytes_b[j]), j + 1
            groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
            links.append((own_a[-1], own_b[-1]))
        counts.update(links)
        rows.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(*r[:3], len(r[3]), sum(counts[p] == best[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), r[4]) for r in rows], counts


def strange(seed, n):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", " ", "\x1c", "\x00", "▁", "é", "é", "漢字", "\U0001f600", "<|endoftext|>", "</s>", "<0x0A>", "don't", "12,3", "word", "Word.", "ab", "​", "\x85"]
    return ["".join(rng.choice(bits) + rng.choice(["", "a", " b", "xy"]) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("block", [al.BLOCK_BYTES, 500])
def test_alignment(spark, odd_docs, odd_texts, monkeypatch, block):
    """Also over many small blocks, and with units met before."""
    monkeypatch.setattr(al, "BLOCK_BYTES", block)
    texts = odd_texts + [(100 + i, t) for i, t in enumerate(strange(1, 300))]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(texts[len(odd_texts) :], "doc_id long, text string"))
    expected, counts = plain([t for _, t in texts])
    found = al.align_tokenizers(docs, A, B, with_groups=True)
    rows = {r.doc_id: r for r in found.documents.collect()}
    got = [tuple(rows[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for i, _ in texts]
    assert got == expected
    assert {(r.a_id, r.b_id): r.n_links for r in found.pairs.collect()} == counts
    assert rows[8].groups.count("|") == rows[8].n_groups


def test_units():
    """Units looked up give what whole texts give, in a worker that forgets."""
    texts, work, forgets = strange(2, 3000) + [prose(k, 50) for k in range(50)], al.Aligner(A, B), al.Aligner(A, B)
    whole = [forgets.whole(t) for t in texts]
    for _ in range(2):
        for text, (numbers, keys, groups), alone in zip(texts, work.texts_of(texts), whole, strict=True):
            expected = alone or ([0] * 4, [], "")
            assert (list(numbers), list(keys), groups) == (list(expected[0]), list(expected[1]), expected[2]), repr(text)


def test_overlap():
    """Links of tokens that share a byte, and a text of one long word."""
    work = al.Aligner(A, B, "overlap")
    for text in ["internationalisation of unheard things", "a" * 5000]:
        x = work.encode(" " + text)
        begins_a, begins_b = x.ends_a - work.sizes_a[x.a], x.ends_b - work.sizes_b[x.b]
        every = {(i, j) for i in range(len(x.a)) for j in range(len(x.b)) if begins_a[i] < x.ends_b[j] and begins_b[j] < x.ends_a[i]}
        assert set(zip(x.link_a.tolist(), x.link_b.tolist(), strict=True)) == every and len(x.link_a) == len(every)


def test_edges(spark, no_docs, nameless):
    assert al.align_tokenizers(no_docs, A, B).documents.count() == 0
    found = al.align_tokenizers(nameless, A, B).documents.collect()
    assert sorted((r.doc_id or -1, r.n_a > 0, r.groups_sha256 == "") for r in found) == sorted([(-1, True, False)] * 2 + [(4, True, False)] * 2 + [(4, False, True), (-1, False, True), (3, False, True)])


def test_query(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected, _ = plain([r.text for r in texts])
    rows = {r.doc_id: tuple(r[1:]) for r in al.op11_alignment(spark, sf_dir).collect()}
    assert rows == {r.doc_id: e for r, e in zip(texts, expected, strict=True)}
