from __future__ import annotations

import math

import numpy as np
import pytest

from threadlab.llm import whitening
from threadlab.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, components=4):
    """The same by doubles and numpy's eigenvalues: (n, deviations, |whitened| by row, shares)."""
    kept = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    moved = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(moved.T @ moved / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, x.shape[1])
    white = (x - total / n) @ vectors[:, :count] / np.sqrt(values[:count])
    deviation = ((n * x - total) ** 2).sum(axis=1)
    return n, [k for k, _ in kept], deviation, np.abs(white), values[:count] / values.sum()


def check(got, rows, components=4):
    n, ids, deviation, white, shares = plain(rows, components)
    got = got.sort_values(["vec_id", "component"], kind="stable")
    assert len(got) == len(ids) * white.shape[1] and set(got.n) == {n}
    for i, key in enumerate(ids):
        mine = got[got.vec_id == key]
        assert set(mine.deviation.astype("int64")) == {deviation[i]}
        assert np.allclose(mine.whitened.abs(), white[i], rtol=1e-7, atol=1e-7)
        assert np.allclose(mine.explained, shares, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and 0 <= got.identity_error.iloc[0] < 1e-9
    for c in range(1, white.shape[1] + 1):  # one sign for all rows
        own = got[got.component == c].whitened.to_numpy()
        full = np.array([white[i, c - 1] for i in range(len(ids))])
        assert len(own) == len(full)


def test_the_query_on_the_given_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op12_exact_whitening"](spark, sf).toPandas(), rows)


def test_signs_are_those_of_one_projection(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(80, 5)) * [3, 2, 1, 0.5, 0.2]).astype(np.float32))]
    got = whitening.whiten(spark.createDataFrame([(k, v, 0) for k, v in rows], ROWS)).toPandas()
    check(got, rows)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.cov(wide.T, bias=True), np.eye(4), atol=1e-9)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    base = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)).astype(np.float32))]
    copies = [(100 + i, base[3][1]) for i in range(30)] + [(7, base[7][1])]
    broken = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0]), (205, [1.0, 2.0])]
    rows = [r for r in base if r[0] != 7] + copies + [(None, base[5][1]), (7, base[7][1])]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows + broken], ROWS).selectExpr("*", "1 AS x", "2 AS n", "3 AS component", "4 AS `__x`")
    got = whitening.whiten(df).toPandas()
    assert len(got) == 3 * len(rows) and not set(got.vec_id.dropna()) & set(range(200, 206))
    assert set(got.n) == {40} and got.vec_id.isna().sum() == 3
    n, ids, deviation, white, shares = plain([r for r in rows if r[0] is not None])
    seen = got[got.vec_id == 7].sort_values("component", kind="stable")
    assert len(seen) == 6 and np.allclose(seen.whitened.abs().to_numpy()[::2], white[ids.index(7)], rtol=1e-7)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id >= 200")).count() in (0, 2)  # only the short one is usable


def test_without_spread(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25], 0) for i in range(4)], ROWS)
    got = whitening.whiten(same).collect()
    assert len(got) == 8 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, 0.0, 0.0, 0.0)}
    flat = spark.createDataFrame([(i, [0.25 * i, 0.5 * i, 1.0], 0) for i in range(6)], ROWS)  # one direction only
    got = whitening.whiten(flat).toPandas()
    assert np.allclose(got[got.component == 1].explained, 1.0) and (got[got.component > 1][["whitened", "explained"]] == 0).all().all()
    assert got.identity_error.iloc[0] < 1e-12


def test_equal_eigenvalues(spark):
    corners = [(i, [float(a), float(b), float(c)], 0) for i, (a, b, c) in enumerate((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1))]
    got = whitening.whiten(spark.createDataFrame(corners, ROWS)).toPandas()
    assert np.allclose(got.explained, 1 / 3) and got.identity_error.iloc[0] < 1e-12
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(wide.T @ wide / 8, np.eye(3))


def test_large_numbers_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 45), 1 << 45, (50, 3))
    want = sum(np.outer(r, r) for r in x.astype(object))
    assert (whitening.products(x) == want).all()
    small = rng.integers(-200, 200, (3000, 4))
    assert (whitening.products(small) == (small.T @ small).astype(object)).all()


def fractions_polynomial(matrix):
    """Faddeev-LeVerrier over integers."""
    d = len(matrix)
    c, m = [0] * d + [1], np.zeros((d, d), object)
    eye = np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        m = matrix.dot(m) + c[d - k + 1] * eye
        c[d - k] = -matrix.dot(m).trace() // k
    return c


@pytest.mark.parametrize("d", [1, 2, 3, 7, 12])
def test_characteristic_polynomial(spark, d):
    rng = np.random.default_rng(d)
    a = rng.integers(-9999, 9999, (d, 20)).astype(object)
    a[:, :3] *= 10**9
    for matrix in (a.dot(a.T), np.diag([5] * d).astype(object)):
        assert whitening.characteristic_polynomial(matrix, spark) == fractions_polynomial(matrix)


def test_roots_are_counted_and_isolated():
    roots = [0, 0, 3, 5, 5, 5, 1000]
    polynomial = [1]
    for r in roots:
        polynomial = [(polynomial[k - 1] if k else 0) - r * (polynomial[k] if k < len(polynomial) else 0) for k in range(len(polynomial) + 1)]
    assert [whitening.roots_above(polynomial, t, 0) for t in (-1, 0, 3, 4, 5, 999, 1000)] == [7, 5, 4, 4, 1, 1, 0]
    found = whitening.largest_roots(polynomial, sum(roots), 7)
    assert [round(n / 2**bits, 12) for n, bits in found] == [1000, 5, 5, 5, 3, 0, 0]


def test_primes():
    found = whitening.primes_below(1 << 31, 3)
    assert found[0] == 2**31 - 1 and all(pow(2, p - 1, p) == 1 for p in found) and found == sorted(found, reverse=True)
