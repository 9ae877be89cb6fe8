"""Whitening against exact sums and a dense eigenvalue decomposition."""

import math

import numpy as np
import pytest

from quarry.llm import whitening as wh


def plain(vectors, most=8):
    """deviation by row; components by falling eigenvalue of the covariance; whitened; explained."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    shifted = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array([[c / n for c in row] for row in shifted])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, [sum(c * c for c in row) for row in shifted], centred @ v[:, :most] / np.sqrt(e[:most]), e[:most] / e.sum()


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, i, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, component long, vector string").repartition(5)


def test_against_dense(spark, monkeypatch):
    """Ties, copies and bad rows; triangles meet in several rounds."""
    monkeypatch.setattr(wh, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((300, 12)) * np.linspace(0.05, 2, 12)).astype(np.float32)
    vectors[100:200] = vectors[100]
    good = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf"), *[0.0] * 11]), (1004, [1.0] * 5), (1005, []), (1006, [1e30] * 12)]
    found = wh.whitening(table(spark, good + bad)).collect()
    n, deviation, whitened, explained = plain(vectors.tolist())
    assert len(found) == 8 * n and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    got = np.zeros((n, 8))
    for r in found:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        got[r.vec_id, r.component - 1] = r.whitened
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.allclose(got, whitened * signs, atol=1e-8)


def test_precise_deviations():
    """Standard deviations of columns of very different sizes, each to relative precision."""
    rng = np.random.default_rng(1)
    scale = 10.0 ** -np.arange(0, 14, 2)
    r = wh.triangle([rng.standard_normal((50, 7)) * scale])
    v, lengths = wh.jacobi(r)
    assert np.allclose(v.T @ v, np.eye(7), atol=1e-13) and np.all(np.diff(lengths) <= 0)
    turned = r @ v
    assert np.allclose(np.sqrt((turned**2).sum(0)) / lengths, 1, rtol=1e-6)
    assert np.allclose(lengths[:4], np.linalg.svd(r, compute_uv=False)[:4], rtol=1e-9)


def test_large_numbers(spark):
    """Sums and squares beyond 64 bits stay exact."""
    vectors = [[(-1) ** i * 4e9 - i, 3.5 * i] for i in range(9)]
    _, deviation, _, _ = plain(vectors)
    found = wh.whitening(table(spark, list(enumerate(vectors)), "double")).collect()
    assert {r.vec_id: int(r.deviation) for r in found} == dict(enumerate(deviation)) and max(deviation) > 2**63


def test_edges(spark):
    assert wh.whitening(table(spark, [])).count() == 0
    assert wh.whitening(table(spark, [(1, None), (2, [])])).count() == 0
    one = wh.whitening(table(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = wh.whitening(table(spark, [(None, [0.0, 7.0]), (2, [1.0, 7.0]), (2, [1.0, 7.0])])).collect()
    assert len(flat) == 6 and all((r.whitened is None) == (r.component == 2) for r in flat) and {r.explained for r in flat} == {1.0, 0.0}


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviation, whitened, explained = plain([r.embedding for r in rows])
    at = {r.vec_id: k for k, r in enumerate(rows)}
    got = np.zeros((n, 8))
    for r in wh.op12_whitening(spark, sf_dir).collect():
        assert r.deviation == deviation[at[r.vec_id]] and r.identity_error < 1e-9 and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        got[at[r.vec_id], r.component - 1] = r.whitened
    assert np.allclose(got, whitened * np.sign((got * whitened).sum(axis=0)), atol=1e-7)
