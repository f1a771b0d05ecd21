"""Whitening against a plain eigendecomposition and exact whole numbers."""

import math

import numpy as np
import pytest

from authsignal.llm import whitening
from tests.conftest import SMALL

VECTOR = "vec_id long, embedding array<double>, x long, n long, component int, _key int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], VECTOR)


def plain(rows):
    """Whole vectors by row, the fit list and its exact covariance as fractions rounded once."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[k] for x in distinct) for k in range(d)]
    y = np.array([[n * c - s for c, s in zip(x, sums)] for x in distinct], dtype=object)
    cov = np.array([[int(v) / n**3 for v in row] for row in y.T @ y], dtype=float)
    return kept, n, sums, cov


def check(df, rows, most=16):
    kept, n, sums, cov = plain(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes.T[::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()))
    signs = {}
    for i, x in kept:
        assert sorted(got[i]) == list(range(1, k + 1))
        for c, found in got[i].items():
            z = np.array([(n * a - s) / n for a, s in zip(x, sums)])
            want = float(z @ axes[c - 1] / math.sqrt(values[c - 1]))
            row = found.pop()
            if abs(want) > 1e-6:
                assert signs.setdefault(c, np.sign(want * row.whitened)) == np.sign(want * row.whitened)
            assert abs(abs(want) - abs(row.whitened)) < 1e-7
            assert row.n == n and row.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert row.explained == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)
            assert row.identity_error < 1e-9
    assert not any(found for parts in got.values() for found in parts.values())


def test_whitening_equals_plain_computation(spark):
    draw = np.random.default_rng(5)
    rows = [(k, (draw.standard_normal(6) * [3, 2, 1.5, 1, 0.7, 0.4]).tolist()) for k in range(200)]
    rows += [(500 + k, rows[0][1]) for k in range(100)] + [(9, rows[9][1])]
    df = vectors(spark, rows)
    check(whitening.whiten(df, whitening.fit(df, 4)), rows, 4)


def test_odd_rows(spark):
    odd = [
        (0, None), (1, []), (2, [1.0, None, 0.0]), (3, [float("nan"), 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0]), (5, [1.0, 2.0]),
    ]
    good = [(10 + k, [float(k % 3), float(k % 5) / 7, 0.0]) for k in range(12)] + [(10, [0.0, 0.0, 0.0]), (30, [-0.001, 0.0, -0.0])]
    df = vectors(spark, odd + good)
    check(whitening.whiten(df, whitening.fit(df)), good)
    assert {r.vec_id for r in whitening.whiten(df, whitening.fit(df)).collect()} == {i for i, _ in good}
    null_id = vectors(spark, [*good, (None, [9.0, 9.0, 9.0])])
    assert whitening.whiten(null_id, whitening.fit(null_id)).where("vec_id IS NULL").count() == 3


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    df = vectors(spark, rows)
    assert whitening.whiten(df, whitening.fit(df)).collect() == []


def test_wide_values_stay_exact(spark):
    rows = [(k, [(-1) ** k * 3e38 / (k + 1), float(k), 1e12 * k * k]) for k in range(9)]
    df = vectors(spark, rows)
    model = whitening.fit(df)
    assert model.n == 9 and all(isinstance(s, int) for s in model.sums)
    assert all(np.isfinite(r.whitened) for r in whitening.whiten(df, model).collect())


def test_square_sums_of_any_size():
    draw = np.random.default_rng(1)
    for top in (10, 2**31, 2**40, 2**61):
        y = draw.integers(-top, top, (300, 4))
        assert whitening.square_sums(y) == [sum(int(v) ** 2 for v in column) for column in y.T]
    for value in (0, 5, -5, 3**200, -(3**200)):
        assert sum(part << (whitening.LIMB * k) for k, part in whitening.limbs(value)) == value


def test_query(spark):
    from authsignal.llm.queries import op11_whitening

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(op11_whitening(spark, SMALL), rows)
