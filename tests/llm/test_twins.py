"""The two classifiers' scores against plain loops over whole texts, given what they have learned."""

import math
import re

import numpy as np
import pytest
import zstandard

from quarry.llm import language, quality

SF_DIR = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def plain_quality(text, model):
    """Each piece compressed by itself with either dictionary; the difference of sizes by byte; the curve."""
    data, sizes = (text or "").encode(), []
    for known in (model.good, model.bad):
        own = zstandard.ZstdCompressionDict(known)
        own.precompute_compress(level=quality.LEVEL)
        packer = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(packer.compress(data[i : i + quality.PIECE])) for i in range(0, len(data), quality.PIECE)))
    difference = (sizes[1] - sizes[0] + quality.PSEUDO_BYTES * model.usual) / (len(data) + quality.PSEUDO_BYTES)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, model.slope * difference + model.bias))))


def test_quality_scores(spark, odd_docs, odd_texts):
    docs = documents(spark)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = quality.fit(docs, labels.filter(~quality.held_out()))
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert len(found) == len(texts)
    for doc_id, text in texts:
        wanted = plain_quality(text, model)
        assert found[doc_id].score == pytest.approx(wanted, rel=1e-9) and found[doc_id].predicted == int(found[doc_id].score >= 0.5)
    queried = {r.doc_id: (r.score, r.predicted) for r in quality.op2_quality(spark, SF_DIR).collect()}
    assert queried == {i: (r.score, r.predicted) for i, r in found.items()}
    odd = {r.doc_id: r.score for r in quality.classify(odd_docs, model).collect()}
    assert odd == {i: pytest.approx(plain_quality(t, model), rel=1e-9) for i, t in odd_texts}


def grams(data):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}


def as_bytes(code):
    """The n-gram of a code: those of one byte first, then of two, then of three, each in order."""
    for n in (1, 2, 3):
        if code < 256**n:
            return int(code).to_bytes(n, "big")
        code -= 256**n
    raise ValueError(code)


def test_language_scores(spark, odd_docs, odd_texts):
    """Kernel values one by one, from sets of n-grams; margins and scores from the dual weights."""
    docs = documents(spark)
    model = language.fit(docs.filter(~quality.held_out(folds=4, fold=2)))
    known = [as_bytes(c) for c in model.grams]
    all_known = set(known)
    landmarks = [{known[k] for k in np.flatnonzero(row)} for row in model.landmarks]
    assert np.allclose(model.landmarks.sum(axis=1), [math.sqrt(len(x)) for x in landmarks], rtol=1e-4)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()][:150] + [(10_000 + i, t) for i, t in odd_texts if len(t or "") < 20_000]
    rows = docs.select("doc_id", "text").union(odd_docs.selectExpr("doc_id + 10000 AS doc_id", "text"))
    found = {r.doc_id: r for r in language.identify(rows, model).collect()}
    for doc_id, text in texts:
        if not re.search(r"[^\W\d_]", text or ""):
            assert (found[doc_id].lang_pred, found[doc_id].score) == ("und", 0.0)
            continue
        own = grams(text.encode()) & all_known
        kernel = np.array([len(own & x) / math.sqrt(max(len(own), 1) * max(len(x), 1)) for x in landmarks])
        margins = kernel @ model.dual.astype(float) + model.bias
        e = np.exp(model.sharpness * (margins - margins.max()))
        assert found[doc_id].lang_pred == model.languages[int(margins.argmax())] or np.sort(margins)[-1] - np.sort(margins)[-2] < 1e-3
        assert found[doc_id].score == pytest.approx(float(e.max() / e.sum()), abs=2e-3)
