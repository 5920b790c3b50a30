"""Whitening against dense linear algebra on the whole matrix; the qd solver on hard factors."""

import math

import numpy as np
import pytest

from tidemark.llm import bidiagonal as bd
from tidemark.llm.whitening import op11_embedding_whitening, whiten

FACTORS = {
    "random": np.random.default_rng(1).standard_normal((40, 40)),
    "graded": np.diag(10.0 ** -np.arange(0, 12, 0.4)) @ np.random.default_rng(2).standard_normal((30, 30)),
    "equal": np.eye(12) * 3.0,
    "rank 3": np.random.default_rng(3).standard_normal((20, 3)) @ np.random.default_rng(4).standard_normal((3, 20)),
    "zero": np.zeros((5, 5)),
    "one": np.array([[2.0]]),
    "cluster": np.linalg.qr(np.random.default_rng(5).standard_normal((24, 24)))[0]
    @ np.diag([5.0] * 8 + [2.0 + 1e-9 * i for i in range(8)] + [1.0] * 8)
    @ np.linalg.qr(np.random.default_rng(6).standard_normal((24, 24)))[0],
}


@pytest.mark.parametrize("name", FACTORS)
def test_solver(name):
    factor = FACTORS[name]
    values, axes = bd.directions(factor, 16)
    want = np.linalg.svd(factor, compute_uv=False)
    assert np.allclose(values, want, rtol=0, atol=1e-13 * max(want[0], 1.0))
    k = axes.shape[1]
    assert k == min(16, int((want > len(want) * bd.EPS * want[0]).sum()))
    assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-10)
    assert np.allclose(np.linalg.norm(factor @ axes, axis=0), values[:k], atol=1e-11 * max(want[0], 1.0))


def integers(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def check(rows, got, components=16):
    """All columns against covariance and eigenvectors of the whole list."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    for dims in {len(v) for _, v in good}:
        group = [(i, integers(v)) for i, v in good if len(v) == dims]
        fit = sorted(set(tuple(x) for _, x in group))
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centred = (np.array(fit, dtype=object) * n - np.array(sums, dtype=object)).astype(float) / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        k = min(components, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
        mine = [r for r in got if r.vec_id in {i for i, _ in group}]
        assert len(mine) == k * len(group)
        by_id = {}
        for r in mine:
            by_id.setdefault(r.vec_id, {})[r.component] = r
        signs = None
        for i, x in group:
            gaps = [n * c - s for c, s in zip(x, sums)]
            want = (np.array(gaps, dtype=float) / n) @ vectors[:, :k] / np.sqrt(values[:k])
            have = np.array([by_id[i][c].whitened for c in range(1, k + 1)])
            signs = np.where(np.sign(want) == np.sign(have), 1, -1) if signs is None else signs
            assert np.allclose(np.abs(want), np.abs(have), atol=1e-6)
            for c in range(1, k + 1):
                r = by_id[i][c]
                assert (r.n, r.deviation) == (n, sum(g * g for g in gaps))
                assert abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-8


def test_rows(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 7)) @ np.diag([9, 5, 4, 3, 2, 1, 0.5])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1]) for i in range(200)]
    rows += [(400, None), (401, []), (402, [None] * 7), (403, [float("nan")] + [1.0] * 6), (404, [float("inf")] + [1.0] * 6)]
    rows += [(500 + i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((9, 3)))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, n long")
    check(rows, whiten(df.repartition(40)).collect())


def test_little_or_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    far = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])], schema)
    got = whiten(far).collect()
    assert len(got) >= 3 and {r.deviation for r in got} >= {None}


def test_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(rows, op11_embedding_whitening(spark, folder).collect())
