"""Whitening against whole-number sums in Python and a dense eigenvalue solver."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from wattloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, key string, vector int, component string, n int"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], SCHEMA).repartition(
        partitions
    )


def fitted(rows):
    """Whole numbers, their count and sums, and covariance in doubles."""
    usable = [
        (i, [math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v])
        for i, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    sizes = [len(v) for _, v in usable]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s))
    usable = [(i, v) for i, v in usable if len(v) == d]
    n, sums = len(usable), [sum(v[j] for _, v in usable) for j in range(d)]
    moved = [[n * x - s for x, s in zip(v, sums)] for _, v in usable]
    exact = [[sum(m[i] * m[j] for m in moved) for j in range(d)] for i in range(d)]
    covariance = np.array([[float(Fraction(e, n**3)) for e in row] for row in exact])
    return usable, n, moved, covariance


def checked(spark, rows, count=32):
    usable, n, moved, covariance = fitted(rows)
    values = np.linalg.eigvalsh(covariance)[::-1]
    d = len(values)
    got = whitening.whiten(frame(spark, rows), count).collect()
    known = min(count, int((values > values[0] * 1e-12).sum()))
    assert len(got) == len(usable) * known
    assert {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    deviations = [(i, sum(x * x for x in m)) for (i, _), m in zip(usable, moved)]
    assert set(by) == set(deviations)
    explained = {r.component: r.explained for r in got}
    for c, e in explained.items():
        assert abs(e - values[c - 1] / np.trace(covariance)) <= 1e-9 * e + 1e-14
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    # Inner products of whitened rows do not depend on signs: compare with the solver's.
    vectors = np.linalg.eigh(covariance)[1][:, ::-1][:, :known]
    want = (np.array(moved, float) / n) @ (vectors / np.sqrt(values[:known]))
    for (i, dev), z in list(zip(deviations, want))[:40]:
        mine = np.zeros(known)
        for r in by[i, dev]:
            mine[r.component - 1] = r.whitened
        if len(by[i, dev]) == known and d <= known:
            assert np.isclose(mine @ mine, z @ z, rtol=1e-7)
    return got


def test_random_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2 + j / 10) for j in range(12)]) for i in range(300)]
    rows += [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12)]
    rows += [(904, [1.0, 2.0]), (905, []), (None, [0.5] * 12), (3, rows[3][1]), (3, rows[4][1])]
    checked(spark, rows)
    few = checked(spark, rows, count=4)
    assert {r.component for r in few} == {1, 2, 3, 4}
    assert {r.vec_id for r in few} >= {None, 0, 3}


def test_equal_eigenvalues_and_no_variance(spark):
    # Corners of a cross: every direction of four has the same variance; the fifth has none.
    rows = [(i, [0.0] * j + [s] + [0.0] * (4 - j)) for i, (j, s) in
            enumerate(itertools.product(range(4), (1.0, -1.0)))]
    got = checked(spark, rows * 3)
    assert {r.component for r in got} == {1, 2, 3, 4}
    assert all(abs(r.explained - 0.25) < 1e-15 for r in got)


def test_tables_that_cannot_be_whitened(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0


def test_far_values_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 1) * 2.0**30, 0.25 * i]) for i in range(50)]
    rows += [(99, [1e30, 0.0, 0.0])]  # its floor is held at 2**62
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 51 * 3 and got[0].identity_error < 1e-4
    assert max(r.deviation for r in got) == (1 << 63) - 1


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (100, 1 << 30, 1 << 50, 1 << 62):
        rows = rng.integers(-top, top, (70, 5))
        big = rows.astype(object)
        assert (whitening.products(rows) == big.T.dot(big)).all()
    for value in (0, 5, -5, (1 << 200) + 17, -(1 << 200) - 17):
        assert sum(x << (whitening.LIMB * k) for k, x in enumerate(whitening.limbs(value))) == value


def expanded(roots):
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    return poly


@pytest.mark.parametrize("roots", [[1, 2, 3], [5, 5, 9, 0, 0], [7], [0, 0], [1 << 70, (1 << 70) + 1, 3, 3, 3]])
def test_roots(roots):
    poly = expanded(roots)
    positive = sorted((r for r in roots if r), reverse=True)
    for at in {0, 1, 2, 4, 5, 1 << 70, *roots}:
        assert whitening.roots_above(poly, at, 0) == sum(r > at for r in roots)
        assert whitening.roots_above(poly, 2 * at + 1, -1) == sum(2 * r > 2 * at + 1 for r in roots)
        sign = math.prod((at > r) - (at < r) for r in roots)
        assert whitening.value_sign(poly, at, 0) == sign
    got = whitening.largest_roots(poly, 4)
    assert len(got) == min(4, len(positive))
    for (a, power, _), root in zip(got, positive):
        assert abs(Fraction(a) * Fraction(2) ** power - root) <= Fraction(root, 1 << 110)


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(4)
    half = rng.integers(-50, 50, (7, 9)).astype(object)
    half[3] = half[2]  # singular
    matrix = half.dot(half.T).tolist()
    poly = whitening.characteristic_polynomial(spark, matrix)
    assert poly[-1] == 1 and poly[-2] == -sum(matrix[i][i] for i in range(7)) and poly[0] == 0
    for x in (-3, 1, 10_007):
        m = [[Fraction((x if i == j else 0) - matrix[i][j]) for j in range(7)] for i in range(7)]
        value = Fraction(1)
        for k in range(7):  # determinant by elimination
            pivot = next((i for i in range(k, 7) if m[i][k]), None)
            if pivot is None:
                value = Fraction(0)
                break
            if pivot != k:
                m[k], m[pivot], value = m[pivot], m[k], -value
            value *= m[k][k]
            for i in range(k + 1, 7):
                f = m[i][k] / m[k][k]
                m[i] = [a - f * b for a, b in zip(m[i], m[k])]
        assert sum(c * x**k for k, c in enumerate(poly)) == value


def test_vectors_of_close_roots_are_orthonormal():
    rng = np.random.default_rng(5)
    half = rng.integers(-9, 9, (6, 6)).astype(object)
    matrix = (half.dot(half.T) * 10**9 + np.diag([0, 0, 0, 1, 1, 1]).astype(object)).tolist()
    spread = np.linalg.eigh(np.array(matrix, float))
    for value, vector in zip(spread[0][::-1][:3], spread[1].T[::-1][:3]):
        a = int(value * 2**20)
        got = np.array(whitening.null_vectors(matrix, (a, -20), 1)[0])
        assert abs(got @ got - 1) < 1e-15 and abs(abs(got @ vector) - 1) < 1e-9
    both = np.array(whitening.null_vectors([[4, 0, 0], [0, 4, 0], [0, 0, 1]], (8 * 2**100 + 1, -101), 2))
    assert np.allclose(both @ both.T, np.eye(2), atol=1e-15) and np.allclose(both[:, 2], 0)
