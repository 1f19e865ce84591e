from __future__ import annotations

import numpy as np
import pytest

from changeflow.llm import whitening

KIND = "vec_id long, embedding array<double>"


def whole(vectors):
    return [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]


def covariance(vectors):
    x = np.array(whole(vectors), object)
    y = np.array(x - x.mean(axis=0), float)
    return y.T @ y / len(y), y


def check(spark, vectors, most=32):
    out = whitening.whitened(spark.createDataFrame(list(enumerate(vectors)), KIND), most).collect()
    v, y = covariance(vectors)
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(most, int((values > 1e-10 * values[0]).sum()))
    assert len(out) == k * len(vectors)
    n, x = len(vectors), whole(vectors)
    sums = [sum(c) for c in zip(*x, strict=True)]
    made = np.zeros((n, k))
    for r in out:
        made[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9) and r.identity_error < 1e-6
    for c in range(k):
        apart = min([abs(values[c] - w) for j, w in enumerate(values) if j != c], default=1) > 1e-6 * values[0]
        if apart:
            want = y @ directions[:, c] / np.sqrt(values[c])
            sign = np.sign(want @ made[:, c])
            assert np.allclose(made[:, c], sign * want, atol=1e-7)
    assert np.allclose(made.T @ made / n, np.eye(k), atol=1e-8)
    return out


def test_components_equal_a_dense_solver(spark):
    made = np.random.Generator(np.random.PCG64(3))
    basis = made.standard_normal((24, 24)) * (0.8 ** np.arange(24))[:, None]
    vectors = (made.standard_normal((300, 24)) @ basis).tolist()
    check(spark, vectors, 10)
    check(spark, vectors, 32)


def test_equal_eigenvalues_and_few_vectors(spark):
    square = [[float(s * (i == k)) for i in range(6)] for k in range(6) for s in (-1, 1)]
    check(spark, square)
    check(spark, [[1.0, 2.0, 3.0], [2.0, 0.5, -1.0]])
    check(spark, [[0.1 * k] for k in range(5)])


def test_one_vector_very_often(spark):
    made = np.random.Generator(np.random.PCG64(4))
    check(spark, made.standard_normal((40, 8)).tolist() + [[5.0] * 8] * 80)


def test_large_entries_are_exact(spark):
    made = np.random.Generator(np.random.PCG64(5))
    check(spark, (made.standard_normal((30, 4)) * 1e5).round(3).tolist())


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0])]
    rows += [(8, [3.0, 1.0]), (8, [3.0, 1.0]), (None, [0.0, 0.5])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], KIND + ", v int, component int")
    out = whitening.whitened(df).collect()
    assert sorted(str(r.vec_id) for r in out) == sorted(["1", "8", "8", "None"] * 2) and {r.n for r in out} == {4}
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id = 8")).count() == 0  # no variance
    assert whitening.whitened(df.where("vec_id IN (2, 6)")).count() == 0


def test_inertia_counts():
    made = np.random.Generator(np.random.PCG64(6))
    for d in (1, 2, 7, 30):
        a = made.standard_normal((d, d))
        a = a + a.T
        for shift in made.standard_normal(12) * 4:
            assert whitening.inertia(a, shift) == (np.linalg.eigvalsh(a) < shift).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_a_missing_component_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(whitening, "intervals", lambda matrix, most: [(0.5, 4.0, 3)])
    with pytest.raises(ArithmeticError):
        whitening.components(spark, np.diag([1.0, 2.0, 9.0]), 2)
