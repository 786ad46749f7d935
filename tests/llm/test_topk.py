"""Exact search against brute force in whole numbers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from wattloom.llm import topk_search

SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, vector int, score int"


def slow(rows, k):
    usable = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in usable if i % 20 == 0}):
        found = sorted(
            (-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), i)
            for i, b in usable
            if i != q and len(b) == len(a)
        )
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, k", [(16_384, 20), (3, 4)])
def test_top_k(spark, block, k):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, 1) for _ in range(17)]) for i in range(260)]
    rows += [(1000 + i, [1.0] * 17) for i in range(80)]  # one vector many times: ties
    rows += [(400, None), (401, [None] * 17), (402, [float("nan")] * 17), (403, [float("inf")] * 17)]
    rows += [(420, [1.0, 2.0]), (421, [2.0, 1.0]), (None, [0.5] * 17), (440, [0.0] * 17)]
    rows += [(460, [1e30] * 17), (461, [-1e30] * 17), (300, rows[3][1]), (300, rows[3][1])]
    full = [(i, v, 0, 0, 0, 0) for i, v in rows]
    frame = spark.createDataFrame(full, SCHEMA).repartition(4)
    got = topk_search.top_k(frame, frame.where("vec_id % 20 = 0"), k=k, block=block).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == slow(rows, k)


def test_components_beyond_a_scaled_double(spark):
    big = 2.0**1020
    rows = [(0, [big, 1.0]), (1, [-big, 3.0]), (2, [big, big]), (3, [0.0, 1.0]), (20, [-1e307, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk_search.top_k(frame, frame.where("vec_id % 20 = 0")).collect()
    want = []
    for q, a in rows:
        if q % 20 == 0:
            dot = lambda v: sum(math.floor(Fraction(x) * 64) * math.floor(Fraction(y) * 64) for x, y in zip(a, v))
            found = sorted((-max(-(1 << 63), min((1 << 63) - 1, dot(v))), i) for i, v in rows if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_bounds_rule_out_far_clusters():
    rng = np.random.default_rng(1)
    centres = np.repeat(rng.normal(0, 30, (20, 8)), 8, axis=1)
    vectors = np.repeat(centres, 100, axis=0) + rng.normal(0, 1, (2000, 64))
    ids = np.arange(len(vectors))
    search = topk_search.Searcher(ids[::20], vectors[::20], 20, 64)
    search.see(ids, vectors)
    assert search.left < 0.4 * search.asked
    x = np.floor(64 * vectors).astype(np.int64)
    want = {(q, i) for q in ids[::20] for _, i in sorted((-(x[q] @ x[i]), i) for i in ids if i != q)[:20]}
    assert set(zip(*(a.tolist() for a in search.rows()[:2]))) == want


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk_search.top_k(empty, empty).count() == 0
    one = spark.createDataFrame([(0, [1.0], 0, 0, 0, 0)], SCHEMA)
    assert topk_search.top_k(one, one).count() == 0


def test_bounds_hold_and_get_finer():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 64)) + 1, rng.normal(size=(60, 64)) - rng.random((60, 1))
    exact = a @ b.T
    looser = None
    for n in (1, 4, 16, 64):
        bound = topk_search.segment_statistics(a, n) @ topk_search.segment_statistics(b, n).T
        assert (bound >= exact - 1e-9).all()
        if looser is not None:
            assert (bound <= looser + 1e-9).all()
        looser = bound
    assert np.allclose(bound, exact)


def test_pruning_skips_most_exact_work(monkeypatch):
    rng = np.random.default_rng(1)
    centres = 3 * rng.normal(size=(40, 16)).repeat(4, axis=1)
    vectors = np.floor(64 * (centres[rng.integers(0, 40, 8000)] + 0.2 * rng.normal(size=(8000, 64))))
    searcher = topk_search.Searcher(np.arange(0, 8000, 20), vectors[::20], 20)
    done = []
    real = topk_search.exact_scores
    monkeypatch.setattr(topk_search, "exact_scores", lambda a, b: done.append(len(a)) or real(a, b))
    for at in range(0, 8000, 2000):
        searcher.see(np.arange(at, at + 2000), vectors[at : at + 2000])
    assert 0 < sum(done) < 0.15 * 400 * 6000
    q, i, s = searcher.rows()
    exact = vectors[::20] @ vectors.T
    for n in range(0, 400, 37):
        order = np.lexsort((np.arange(8000), -exact[n]))
        order = order[order != 20 * n][:20]
        assert set(i[q == 20 * n]) == set(order)
