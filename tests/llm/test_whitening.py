"""Bidiagonal solver against the library's eigenvalues; whitening against a covariance from exact integers."""

import math

import numpy as np
import pytest

from tabulark.llm import bidiagonal, whitening, workload


def matrices():
    rng = np.random.RandomState(3)
    for d in (1, 2, 3, 5, 17, 64):
        yield rng.standard_normal((d, d))
        yield np.triu(rng.standard_normal((d, d))) * np.geomspace(1, 1e-9, d)
        yield np.triu(rng.standard_normal((d, d))) * np.geomspace(1e-6, 1e5, d)
        yield np.eye(d) * 3
        yield np.zeros((d, d))
        low = rng.standard_normal((d, max(d // 2, 1)))
        yield low @ low.T
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        yield q * np.where(np.arange(d) < 3, 5.0, 1.0)
        yield q * (1 + 1e-9 * np.arange(d))
        holes = rng.standard_normal((d, d))
        holes[:, :: 2] = 0
        yield holes


def test_solver():
    for a in matrices():
        d = len(a)
        diagonal, upper, right = bidiagonal.bidiagonal(a)
        scale = max(np.abs(a).max(), 1e-300)
        assert np.allclose(right.T @ right, np.eye(d), atol=1e-13)
        b = np.diag(diagonal) + np.diag(upper, 1)
        assert np.allclose(right @ b.T @ b @ right.T, a.T @ a, atol=1e-12 * d * scale**2)
        squares, vectors = bidiagonal.principal(a, 4)
        want = np.linalg.svd(a, compute_uv=False)
        assert np.allclose(np.sqrt(squares), want, atol=1e-13 * d * max(want.max(), 1e-300))
        k = vectors.shape[1]
        assert k == min(4, int((want > 16 * d * 2.3e-16 * want.max()).sum()))
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-11)
        assert np.allclose(a.T @ (a @ vectors), vectors * squares[:k], atol=1e-11 * max(want.max(), 1e-300) ** 2)


def test_small_singular_values_are_accurate():
    """A graded bidiagonal matrix: the values of its inverse, worked out in exact fractions, say what the least one is."""
    diagonal, upper = np.array([1.0, 1e-6, 1e-12, 1e-18]), np.array([1e-3, 1e-9, 1e-15])
    squares = bidiagonal.squared_singular_values(diagonal, upper)
    assert math.isclose(math.sqrt(np.prod(squares)), np.prod(diagonal), rel_tol=1e-13)
    assert np.all(np.abs(np.sqrt(squares) / diagonal - 1) < 1e-5)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "other", 7) for i, v in rows], "vec_id long, v array<double>, x string, dims int")


def plain(rows, components=4):
    """By an eigenvalue decomposition of the exact integer covariance: id -> deviation, |whitened|, explained."""
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = [tuple(math.floor(256.0 * c) for c in v) for _, v in good]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    sums = [sum(r[j] for r in fit) for j in range(d)]
    cov = np.array([[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in fit) / n**3 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values[0] * 1e-12).sum()))
    out = []
    for (i, _), r in zip(good, x):
        dev = sum((n * a - s) ** 2 for a, s in zip(r, sums))
        w = (np.array(r) - np.array(sums) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        out.append((i, dev, w, values[:k] / values.sum()))
    return n, out


@pytest.mark.parametrize("seed", range(2))
def test_against_plain(spark, seed):
    rng = np.random.RandomState(seed)
    mix = rng.standard_normal((6, 6))
    rows = [(i, (rng.standard_normal(6) @ mix).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1]), (5, rows[6][1])]
    rows += [(1, None), (2, [None] * 6), (3, [1, 2, 3, 4, 5, float("nan")]), (4, [float("inf")] * 6), (6, [])]
    n, want = plain(rows)
    got = whitening.whitened(rows_of(spark, rows).repartition(17), "vec_id", "v").collect()
    assert len(got) == 4 * len(want) and {r.n for r in got} == {n} and all(r.identity_error < 1e-10 for r in got)
    for component in range(4):
        ours = sorted((r.vec_id, r.deviation, r.whitened, r.explained) for r in got if r.component == component + 1)
        theirs = sorted((i, dev, w[component], e[component]) for i, dev, w, e in want)
        sign = np.sign(ours[0][2] * theirs[0][2])
        assert [x[:2] for x in ours] == [x[:2] for x in theirs]
        assert np.allclose([x[2] for x in ours], [sign * x[2] for x in theirs], atol=1e-9)
        assert np.allclose([x[3] for x in ours], [x[3] for x in theirs], rtol=1e-10)


def test_odd_tables(spark):
    def got(rows):
        return [tuple(r) for r in whitening.whitened(rows_of(spark, rows), "vec_id", "v").collect()]

    assert got([]) == [] and got([(1, None), (2, [])]) == []
    assert got([(1, [1, 2])]) == [] and got([(1, [1, 2]), (2, [1, 2])]) == []
    line = got([(None, [0, 0, 1]), (2, [1, 2, 1]), (3, [2, 4, 1]), (4, [1]), (2, [1, 2, 1])])
    assert len(line) == 4 and {r[1] for r in line} == {1} and all(math.isclose(r[5], 1.0) for r in line)
    assert sorted(abs(round(r[4], 9)) for r in line) == [0, 0, round(math.sqrt(1.5), 9), round(math.sqrt(1.5), 9)]
    huge = got([(i, [1e9 * i, 3e9]) for i in range(300)])
    assert len(huge) == 300 and any(r[3] is None for r in huge)
    assert len(got([(i, [2.0**52 * (-1) ** i, i]) for i in range(9)])) == 9
    assert len(got([(i, [2.0**53, i]) for i in range(9)])) == 0 and len(got([(i, [-0.0, i / 512]) for i in range(9)])) == 9


def test_query(spark, small):
    got = workload.op12_embedding_whitening(spark, small)
    table = spark.read.parquet(f"{small}/embeddings.parquet").count()
    rows = got.collect()
    assert len(rows) == 4 * table and all(r.identity_error <= 1e-4 for r in rows)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
