"""Whitening against plain sums and NumPy's decomposition of exact moments."""

from fractions import Fraction

import numpy as np
import pytest

from murmuration.llm import whitening


def spread(spark, rows, parts=5, schema="vec_id long, embedding array<double>, n long"):
    return spark.createDataFrame([(*r, 7) for r in rows], schema).repartition(parts)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, {}).setdefault(r.component, []).append(r)
    return out


def test_against_exact_moments(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    rng = np.random.default_rng(4)
    c = rng.normal(size=(300, 12)) * np.linspace(3, 0.01, 12) + 50
    c[100:200] = c[5]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + [(900, None), (901, [None] + [1.0] * 11), (902, [float("nan")] * 12), (903, [float("-inf")] * 12), (5, c[6].tolist()), (None, c[7].tolist())]
    got = by_id(whitening.whiten(spread(spark, rows)))
    c = np.vstack([c, c[6:8]])
    x = np.floor(c * 1024).astype(np.int64) + 100_000
    n, s = len(x), [int(t) for t in x.sum(axis=0)]
    mean = [Fraction(t, n) for t in s]
    cov = np.array([[float(sum((Fraction(int(r[i])) - mean[i]) * (Fraction(int(r[j])) - mean[j]) for r in x) / n) for j in range(12)] for i in range(12)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    want = (x - np.array([float(m) for m in mean])) @ v / np.sqrt(e)
    assert set(got) == {*range(300), None} and {len(r) for k in got for r in got[k].values()} == {1, 2}
    signs = np.sign(want[0] * np.array([got[0][k][0].whitened for k in range(1, 9)]))
    for i in range(300):
        if i == 5:
            continue
        rows_ = [got[i][k][0] for k in range(1, 9)]
        assert np.allclose([r.whitened for r in rows_], want[i] * signs, rtol=1e-9, atol=1e-9)
        assert {r.n for r in rows_} == {n} and {r.deviation for r in rows_} == {sum((n * int(a) - b) ** 2 for a, b in zip(x[i], s))}
        assert np.allclose([r.explained for r in rows_], e / np.trace(cov), rtol=1e-10)
        assert len({r.identity_error for r in rows_}) == 1 and rows_[0].identity_error < 1e-8


def test_partitioning_changes_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)))]
    one, many = (by_id(whitening.whiten(spread(spark, rows, p), components=3)) for p in (1, 40))
    for k in (1, 2, 3):
        a, b = (np.array([g[i][k][0].whitened for i in range(200)]) for g in (one, many))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 5, [[1.0], [2.0], [3.0]], [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]])
def test_without_variance(spark, vectors):
    got = whitening.whiten(spread(spark, list(enumerate(vectors)), 2)).collect()
    assert len(got) == len(vectors) * len(vectors[0])
    spread_ = np.ptp(np.array(vectors), axis=0).any()
    for r in got:
        flat = not spread_ or r.component > 1
        assert (r.whitened == 0 and r.explained == 0) if flat else abs(r.explained - 1) < 1e-9
        assert r.identity_error < 1e-9


def test_lengths_and_size(spark):
    rows = [(0, []), (1, [1.0]), (2, [2.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1e300, 0.0]), (6, [-1e300, 3.0])]
    got = by_id(whitening.whiten(spread(spark, rows, 3)))
    assert {i: {r[0].n for r in g.values()} for i, g in got.items()} == {1: {2}, 2: {2}, 3: {4}, 4: {4}, 5: {4}, 6: {4}}
    assert [got[1][1][0].whitened * got[2][1][0].whitened] == [-1.0]
    assert got[5][1][0].deviation is None and got[1][1][0].deviation == 1024**2


def test_empty(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []
