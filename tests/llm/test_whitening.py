import math
from fractions import Fraction

import numpy as np
import pytest

from brevispark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component int, n int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def table(df):
    """Rows by id, component."""
    return {(r.vec_id, r.component): r for r in df.collect()}


@pytest.mark.parametrize("rows,width,components", [(300, 40, 32), (50, 3, 32), (200, 7, 4)])
def test_equals_plain(spark, rows, width, components):
    rng = np.random.default_rng(rows)
    data = rng.normal(0, 1, (rows, width)) * 2.0 ** rng.integers(-3, 4, width) + 5
    found = table(W.whiten(frame(spark, [(i, [float(c) for c in v]) for i, v in enumerate(data)]), components))
    x = np.floor(64 * data)
    z = x - x.mean(0)
    cov = z.T @ z / rows
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, width)
    assert len(found) == rows * k
    for j in range(k):
        plain = z @ vectors[:, j] / math.sqrt(values[j])
        mine = np.array([found[i, j + 1].whitened for i in range(rows)])
        assert np.allclose(mine, plain * np.sign(plain @ mine), atol=1e-9)
        assert math.isclose(found[0, j + 1].explained, values[j] / values.sum(), rel_tol=1e-12)
    whole = [[int(c) + 1_000_000 for c in v] for v in x]
    sums = [sum(col) for col in zip(*whole)]
    for i in range(rows):
        assert found[i, 1].deviation == sum((rows * c - s) ** 2 for c, s in zip(whole[i], sums)) and found[i, 1].n == rows
    assert 0 <= found[0, 1].identity_error < 1e-10


def test_rotations_keep_small_eigenvalues():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    scale = 10.0 ** -np.arange(12)
    graded = scale[:, None] * (q @ np.diag(np.linspace(1, 2, 12)) @ q.T) * scale
    values, vectors = W.rotate(graded)
    assert np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-14) and (np.diff(values) <= 0).all()
    # the determinant of a graded matrix is that of its factors: its smallest eigenvalues need relative accuracy
    assert math.isclose(np.prod(values), np.prod(np.linspace(1, 2, 12)) * np.prod(scale**2), rel_tol=1e-9)
    assert np.allclose(graded @ vectors, vectors * values, atol=1e-15)
    for n in (1, 2, 5):
        a = rng.normal(size=(n, n))
        assert np.allclose(W.rotate(a + a.T)[0], np.linalg.eigvalsh(a + a.T)[::-1])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    base = [(int(i), [float(x) for x in rng.normal(0, 1, 5)]) for i in range(60)]
    odd = [(None, [1.0] * 5), (7, base[7][1]), (8, [0.5, 2.0]), (90, None), (91, [None] * 5), (92, [nan] * 5), (93, [inf] * 5), (94, [1e300] * 5)]
    rows = W.whiten(frame(spark, base + odd), 3).collect()
    assert {r.n for r in rows} == {63} and len(rows) == 63 * 3 and {r.vec_id for r in rows} == {None, *range(60)}
    cov = np.zeros((3, 3))
    by = {}
    for r in rows:
        by.setdefault(r.deviation, {}).setdefault(r.component, []).append(r.whitened)
    for d in by.values():
        y = np.array([d[1], d[2], d[3]])
        cov += y @ y.T / 63
    assert np.abs(np.triu(cov) - np.eye(3)).max() < 1e-9


def test_without_variance(spark):
    one = W.whiten(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = table(W.whiten(frame(spark, [(i, [float(i), 2.0, -float(i)]) for i in range(9)])))
    assert flat[3, 1].explained == pytest.approx(1) and flat[3, 2].whitened is None and flat[3, 3].explained == 0 and flat[3, 1].identity_error < 1e-12
    assert W.whiten(frame(spark, [(1, None)])).count() == 0 and W.whiten(frame(spark, [(1, [])])).count() == 0


def test_numbers_of_any_size(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), [float(c) for c in rng.normal(0, 1, 3) * 1e12 + 1e15]) for i in range(30)]
    found = table(W.whiten(frame(spark, data), 3))
    x = [[math.floor(64 * c) for c in v] for _, v in data]
    sums = [sum(col) for col in zip(*x)]
    z = [[Fraction(30 * c - s, 30) for c, s in zip(v, sums)] for v in x]
    cov = np.array([[float(sum(v[i] * v[j] for v in z) / 30) for j in range(3)] for i in range(3)])
    assert found[0, 1].explained == pytest.approx(np.linalg.eigvalsh(cov)[-1] / np.trace(cov), rel=1e-12)
    assert found[4, 1].deviation == min((1 << 63) - 1, int(sum((30 * c) ** 2 for c in z[4]))) and found[0, 1].identity_error < 1e-9
