"""Whitening against a dense eigensolver."""

import math

import numpy as np
import pytest

from tracemill.llm import whitening
from tracemill.llm.common import prepare, read_table

SCHEMA = "vec_id bigint, embedding array<float>"


def table(spark, rows, schema=SCHEMA):
    prepare(spark)
    return spark.createDataFrame(rows, schema)


def by_hand(rows, k=4):
    """vec_id -> (n, deviation, explained, whitened) from the whole covariance."""
    good = [(i, [math.floor(256 * np.float64(np.float32(c))) + 0 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in good:
        white = (np.array(x) - fit.mean(axis=0)) @ vectors / np.sqrt(values)
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), values / np.trace(centred.T @ centred / n), white))
    return out


def compare(got, want, k=4):
    assert len(got) == k * len(want)
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    signs = {}
    for at, (i, n, deviation, explained, white) in enumerate(sorted(want, key=lambda w: w[0])):
        for c in range(k):
            row = got[at * k + c]
            assert (row.vec_id, row.component, row.n, row.deviation) == (i, c + 1, n, deviation)
            assert row.explained == pytest.approx(explained[c], rel=1e-10) and row.identity_error < 1e-9
            if abs(white[c]) > 1e-3:
                assert row.whitened / white[c] == pytest.approx(signs.setdefault(c, np.sign(row.whitened / white[c])), abs=1e-6)


def test_against_dense(spark):
    rng = np.random.default_rng(1)
    scales = np.array([3, 2.5, 2, 1.9, 1.85, 1, 1, 0.5, 0.2, 0.1] + [0.05] * 14)
    vectors = (rng.standard_normal((400, 24)) * scales + rng.standard_normal(24)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    rows += [(2000, None), (2001, [None] + rows[1][1][1:]), (2002, [math.nan] + rows[1][1][1:]), (2003, [math.inf] + rows[1][1][1:])]
    rows += [(2004, [-0.0] * 24)]
    got = whitening.whiten(table(spark, rows).repartition(5)).collect()
    compare(got, by_hand(rows))


def test_given_table(spark):
    frame = read_table(spark, "/root/testdata/sf0.01", "embeddings")
    want = by_hand([(r.vec_id, r.embedding) for r in frame.collect()])
    compare(whitening.whiten(frame).collect(), want)


def test_close_eigenvalues_reach_double_precision():
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    values = np.concatenate([[1.0, 1 - 1e-5, 1 - 2e-5, 0.999, 0.9989], rng.random(55) * 0.9])
    matrix = (turn * values) @ turn.T
    got, vectors = whitening.jacobi_davidson(lambda q: matrix @ q, 60, 4)
    assert np.allclose(got, values[:4], rtol=1e-13)
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13


def test_repeated_eigenvalues_and_narrow_spaces():
    for diagonal in ([2.0, 2, 2, 2, 2, 1], [5.0, 5], [1.0], [3.0, 0, 0, 0, 0, 0]):
        matrix = np.diag(diagonal)
        got, vectors = whitening.jacobi_davidson(lambda q, m=matrix: m @ q, len(diagonal), 4)
        assert np.allclose(got, diagonal[:4], atol=1e-14) and np.allclose(matrix @ vectors, vectors * got, atol=1e-13)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(3)
    half = rng.standard_normal((12, 12))
    matrix, right = half + half.T, rng.standard_normal((12, 3))
    assert np.allclose(matrix @ whitening.minres(lambda q: matrix @ q, right, 40, 1e-13), right, atol=1e-8)


def test_large_deviations_stay_exact():
    rows = np.array([[3, -5], [2**30, 1], [2**40, 2]])
    n, sums = 10**3, [7, -11]
    want = [sum((n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in rows]
    assert whitening._deviation(rows, n, sums) == [w if w < 2**63 else None for w in want]
    n, sums = 3 * 10**9, [5, 1]
    edge = np.array([[1, 0], [2, -1]])
    want = [sum((n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in edge]
    assert whitening._deviation(edge, n, sums) == [w if w < 2**63 else None for w in want]


def test_odd_vectors(spark):
    nothing = table(spark, [], SCHEMA)
    assert whitening.whiten(nothing).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows, k in (([], 0), ([(1, None)], 0), ([(1, [])], 0), ([(1, [1.0, 2.0])] * 3, 0), ([(1, [1.0, 2.0]), (None, [2.0, 1.0])], 1)):
        got = whitening.whiten(table(spark, rows)).collect()
        assert len(got) == k * len(rows)
    # The commonest length counts.
    rows = [(i, [float(i), float(i * i)]) for i in range(5)] + [(9, [1.0]), (10, [1.0, 2.0, 3.0])]
    assert {r.vec_id for r in whitening.whiten(table(spark, rows)).collect()} == set(range(5))
    clashing = table(spark, rows).selectExpr("*", "1 AS id", "2 AS x", "'a' AS kind", "3 AS n", "4 AS width")
    assert whitening.whiten(clashing).count() == 10
    huge = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1.0, 2.0])]
    assert whitening.whiten(table(spark, huge, "vec_id bigint, embedding array<double>")).count() == 3
