import math

import numpy as np
import pytest

from recallgrid.llm import whitening


def table(spark, rows):
    """vec_id and embedding, with columns whose names clash with those of the results."""
    return spark.createDataFrame([(i, v, "c", 1.5) for i, v in rows], "vec_id long, embedding array<double>, component string, n double")


def brute(rows, k=16):
    """The contract with numpy's eigenvalues."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    fit = sorted({tuple(x) for x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    centre = lambda x: np.array([(x[i] * n - sums[i]) / n for i in range(d)])
    y = np.array([centre(x) for x in fit])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for (i, _), x in zip(kept, xs, strict=True):
        deviation = sum((n * x[j] - sums[j]) ** 2 for j in range(d))
        out.setdefault(i, []).append((n, deviation, centre(x) @ vectors / np.sqrt(np.maximum(values, 1e-30))))
    return out, values / np.trace(v)


def compared(got, want, shares):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(by) == set(want)
    signs = None
    for i, of in by.items():
        assert sorted(of) == list(range(1, len(shares) + 1))
        n, deviation, values = want[i][0]
        for c, rows in of.items():
            assert len(rows) == len(want[i])
            for r in rows:
                assert (r.n, r.deviation) == (n, deviation) and r.identity_error <= 1e-4
                assert abs(r.explained / shares[c - 1] - 1) <= 1e-4
        mine = np.array([of[c][0].whitened for c in sorted(of)])
        if signs is None and (np.abs(values) > 1e-6).all():
            signs = np.sign(mine * values)
        if signs is not None:
            assert np.allclose(mine, signs * values, atol=1e-6)


def test_whole_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    want, shares = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    compared(whitening.whitened_rows(vectors).collect(), want, shares)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(20) * np.arange(1, 21)).tolist()) for i in range(80)]
    rows += [(i, v) for i, v in rows[:9]] + [(500 + i, rows[0][1]) for i in range(40)]
    odd = [(900, None), (901, [None] * 20), (902, [1.0] * 19 + [None]), (903, [math.nan] * 20), (904, [math.inf] + [0.0] * 19), (905, [])]
    want, shares = brute(rows)
    got = whitening.whitened_rows(table(spark, rows + odd + [(906, [1.0, 2.0]), (907, [1e300] * 20)])).collect()
    compared(got, want, shares)
    assert {r.vec_id for r in whitening.whitened(table(spark, [(None, [0.0, 1.0]), (1, [1.0, 0.0])])).collect()} == {None, 1}


def test_flat_and_empty(spark):
    same = [(i, [0.5, -0.5, 3.0]) for i in range(5)]
    out = whitening.whitened(table(spark, same)).collect()
    assert [(r.n, r.deviation, r.whitened) for r in out] == [(1, 0, [])] * 5
    assert whitening.whitened_rows(table(spark, same)).count() == 0
    assert whitening.whitened_rows(table(spark, [(1, None)]).limit(0)).count() == 0
    assert whitening.whitened(table(spark, [(1, None), (2, [None])])).count() == 0
    line = [(i, [float(i), -2.0 * i, 0.0]) for i in range(10)]
    got = whitening.whitened_rows(table(spark, line)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-9


def test_large_deviations(spark):
    rows = [(i, [1e9 * i, -1e9 * i, 0.25 * i]) for i in range(40)]
    want, _ = brute(rows)
    for r in whitening.whitened(table(spark, rows)).collect():
        exact = want[r.vec_id][0][1]
        assert r.deviation == (exact if exact < 1 << 63 else None)


def _matrix(kind, n, rng):
    if kind == "random":
        a = rng.standard_normal((n, n))
        return a @ a.T / n
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {
        "repeated": np.repeat([5.0, 3.0, 1.0], -(-n // 3))[:n],
        "close": 1 + 1e-9 * np.arange(n),
        "zero": np.zeros(n),
        "rank one": np.eye(1, n)[0],
        "falling": 10.0 ** -np.arange(n),
    }[kind]
    return q * values @ q.T


@pytest.mark.parametrize("kind", ["random", "repeated", "close", "zero", "rank one", "falling"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_leading_pairs(kind, n):
    rng = np.random.default_rng(n)
    a = _matrix(kind, n, rng)
    a = (a + a.T) / 2
    values, vectors = whitening.leading_pairs(a, 16)
    k = min(16, n)
    scale = max(1.0, np.abs(a).max())
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-13 * scale * n)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-10
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * scale * n


def test_split_matrix():
    a = np.diag([3.0, 3.0, 3.0, 1.0, 2.0])
    values, vectors = whitening.leading_pairs(a, 5)
    assert np.allclose(values, [3, 3, 3, 2, 1]) and np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-12)
