"""Whitening against eigenvectors of the exact covariance, on given embeddings and on awkward vectors."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.llm import whitening
from driftlens.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def direct(vectors, components=16):
    """(x of every kept row, n, sums, components as columns, variances, trace) by the whole matrix."""
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000 for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    off = (n * fit - sums).astype(float) / n
    values, axes = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(values)[::-1][:components]
    return x, n, sums, axes[:, order], values[order], values.sum()


def check(df, rows, tolerance=1e-9):
    x, n, sums, axes, values, trace = direct([v for _, v in rows])
    found = {}
    for r in df.collect():
        found.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == len(rows)
    signs = None
    for (key, _), row in zip(rows, x):
        mine = [found[key][k] for k in sorted(found[key])]
        assert [r.component for r in mine] == list(range(1, len(values) + 1))
        expected = (row - sums / n) @ axes / np.sqrt(values)
        told = np.array([r.whitened for r in mine])
        signs = np.sign(told * expected) if signs is None else signs
        assert np.allclose(told, signs * expected, atol=1e-6)
        assert {r.deviation for r in mine} == {sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))}
        assert np.allclose([r.explained for r in mine], values / trace, rtol=tolerance)
        assert {r.n for r in mine} == {n} and len({r.identity_error for r in mine}) == 1 and mine[0].identity_error < 1e-10


def test_given_embeddings(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    check(whitening.whiten(df), [(r.vec_id, r.embedding) for r in df.collect()])


def test_many_scales_and_copies(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 20)) * 10.0 ** np.linspace(3, -1.5, 20)) @ np.linalg.qr(rng.normal(size=(20, 20)))[0]
    vectors = np.concatenate([vectors, vectors[:1].repeat(150, axis=0)]).tolist()
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(7)
    check(whitening.whiten(df), list(enumerate(vectors)), 1e-8)


def test_rank_and_left_out_rows(spark):
    rng = np.random.default_rng(2)
    base = np.floor(rng.normal(size=(40, 3)) * 200) / 64
    vectors = np.concatenate([base, base[:, :1] + base[:, 1:2], np.full((40, 1), 5.0)], axis=1).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, None) for i, v in [*rows, *bad]], SCHEMA).withColumns({c: F.lit("x") for c in ("x", "n", "component")})
    found = whitening.whiten(df)
    assert {r.component for r in found.collect()} == {1, 2, 3}
    assert {r.vec_id for r in found.collect()} == set(range(40))
    x, n, sums, axes, values, trace = direct(vectors, 3)
    told = np.array([r.whitened for r in found.orderBy("vec_id", "component").collect()]).reshape(-1, 3)
    assert np.allclose(np.abs(told), np.abs((x - sums / n) @ axes / np.sqrt(values)), atol=1e-6)
    assert found.first().identity_error < 1e-9


def test_no_or_equal_vectors_have_no_components(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, None, 0)], SCHEMA)
    for df in (some, some.limit(0), some.where("vec_id IS NULL")):
        assert whitening.whiten(df).count() == 0


def test_null_and_repeated_keys_and_huge_entries(spark):
    rows = [(None, [1e30, 0.0], 0), (7, [1.0, 2.0], 0), (7, [1.0, 2.0], 0), (7, [3.0, -1e30], 0), (8, [0.5, 0.25], 0)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 2 * len(rows) and all(r.n == 4 and np.isfinite(r.whitened) for r in found)
    assert any(r.deviation is None for r in found)


def test_passes_make_rows_orthogonal(spark):
    """One shifted pass leaves ill-conditioned rows far from orthogonal; all of them together do not."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 6)) * 10.0 ** np.arange(9, 3, -1)).astype(np.int64)
    x[:, 5] += x[:, 0]
    fitted = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
    sums = x.sum(axis=0).tolist()
    off = np.array([[float(Fraction(int(v)) - Fraction(s, 500)) for v, s in zip(row, sums)] for row in x])
    factor = whitening.triangular_factor(spark, fitted, 500, sums)
    q = np.linalg.solve(factor.T, off.T).T
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-9 and np.allclose(np.tril(factor, -1), 0)
    assert np.allclose(np.linalg.svd(factor)[1], np.linalg.svd(off)[1], rtol=1e-9)


def test_deviations_are_exact():
    rng = np.random.default_rng(4)
    for size in (1 << 20, 1 << 40):
        x = rng.integers(-size, size, (5, 3))
        sums, n = [int(s) for s in x.sum(axis=0)], 5
        exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
        assert whitening._deviations(x, sums, n).to_pylist() == [d if d < 2**63 else None for d in exact]
    assert whitening._deviations(x[:0], sums, n).to_pylist() == []


@pytest.mark.parametrize("width", [1, 5])
def test_triangular_solves(width):
    rng = np.random.default_rng(5)
    factor = np.triu(rng.normal(size=(width, width))) + 3 * np.eye(width)
    rows = rng.normal(size=(7, width))
    assert np.allclose(whitening.solve_rows(rows, factor) @ factor, rows)
