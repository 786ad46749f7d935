"""Ranked search against brute force in whole numbers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents, prose

from wattloom.llm import lexical

ITEMS = "item_id bigint, text string, key string, score int, rank int"


def terms_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(lexical.TERM, lowered)


def slow(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    length = sum(c.total() for _, c in held)
    df = Counter(term for _, c in held for term in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            if not c:
                continue
            m = 50 + (50 * c.total() * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=lambda r: (r[0], r[1]))


def found(spark, docs, items, **options):
    frame = spark.createDataFrame([(*r, None, None, None) for r in items], ITEMS).repartition(2)
    got = lexical.ranked(documents(spark, docs, clashing=True), frame, **options).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=lambda r: r[:2])


def questions(rng, docs):
    items = [(i, prose(rng, rng.randint(3, 20))) for i in range(12)]
    items += [(20 + i, docs[i][1]) for i in range(6)]
    items += [(40, None), (41, ""), (42, "...!? \n"), (43, "zzzz unknown"), (None, "kan"), (44, docs[7][1]),
              (44, docs[8][1]), (45, "É ü 中文 kan KAN Kan"), (46, "x" * 30_000)]
    return items


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"block_terms": 40, "k": 7}])
def test_against_brute_force(spark, options, monkeypatch):
    rng = random.Random(11)
    docs = awkward(n=150)
    docs += [(1000 + i, docs[4][1]) for i in range(90)]  # more copies than are asked for: ties
    docs += [(2000 - i, docs[9][1] + " kan") for i in range(60)]
    items = questions(rng, docs)
    assert found(spark, docs, items, **options) == slow(docs, items, options.get("k", 50))


def test_empty_tables(spark):
    assert found(spark, [], [(1, "kan")]) == []
    assert found(spark, [(1, "kan")], []) == []
    assert found(spark, [(1, None), (2, "")], [(1, "kan"), (2, None)]) == []


def test_bounds_hold_for_every_row_of_a_node():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 10**6, (300, 40)) * (rng.random((300, 40)) < 0.3)
    groups = np.sort(rng.integers(0, 9, 40))
    tree = lexical.BallTree(rows, groups)
    asked = (rng.random((40, 25)) < 0.2).astype(float)
    scores = tree.rows @ asked.astype(np.int64)
    bounds = tree.bounds(asked)
    for (start, end), bound in zip(tree.nodes, bounds):
        assert (scores[start:end].max(0) <= bound).all()
    assert sorted(tree.order) == list(range(300))
    assert (tree.rows == rows[tree.order]).all()


def test_equal_rows_are_one_leaf_with_exact_bounds():
    rows = np.full((500, 3), 7)
    tree = lexical.BallTree(rows, np.array([0, 0, 1]))
    assert tree.nodes == [(0, 500)]
    assert tree.bounds(np.array([[1.0], [1.0], [0.0]]))[0, 0] <= 16


def test_pruning_leaves_out_most_of_a_clustered_table():
    rng = np.random.default_rng(2)
    topics = [np.flatnonzero(rng.random(200) < 0.1) for _ in range(10)]
    search = lexical.Search([np.sort(topics[0])], 5)
    for _ in range(4):
        rows = np.zeros((400, 200), np.int64)
        for i in range(400):
            rows[i, topics[i % 10]] = rng.integers(900, 1000, len(topics[i % 10]))
        search.see(np.arange(400), rows, np.arange(200), np.arange(200) // 4)
    assert search.seen < 0.4 * search.all
    assert len(search.best[0].keys) == 5
