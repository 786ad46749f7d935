"""The classifier: held-out accuracy, the effect of the swap penalty, awkward rows."""

import random

import numpy as np
from helpers import awkward, documents, prose

from wattloom.llm import toxicity

BAD = ("idiot", "scum", "worthless")


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        text, toxic = prose(rng, rng.randint(20, 200)), rng.random() < 0.3
        if toxic:
            words = text.split(" ")
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows, labels = labelled(rng, 900)
    frame = documents(spark, rows, True)
    known = spark.createDataFrame(labels[:600] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    scored = toxicity.with_scores(frame, toxicity.fit(frame, known), out="score")
    assert scored.columns == [c for c in frame.columns if c != "score"] + ["score"]
    got = {r.doc_id: r.score for r in scored.collect()}
    right = sum((got[i] >= 0.7) == bool(y) for i, y in labels[600:])
    assert right >= 0.97 * 300
    assert all(0 <= s <= 1 for s in got.values())


def test_swapping_terms_lowers_false_positives(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.4
        # In training, one group is nearly always attacked and the other nearly never.
        term = rng.choice(("muslim", "christian"))
        if toxic:
            term = "muslim" if rng.random() < 0.95 else "christian"
        elif term == "muslim" and rng.random() < 0.8:
            term = "christian"
        bad = rng.choice(BAD) if toxic and rng.random() < 0.8 else "person"
        rows.append((i, f"{prose(rng, 6)}. The {term} {bad} said so. {prose(rng, 6)}"))
        labels.append((i, int(toxic)))
    frame = documents(spark, rows)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    neutral = documents(spark, [(1, "The muslim person said so."), (2, "The christian person said so."), (3, "The muslim idiot said so.")])
    gap, free = {}, {}
    for penalty in (0.0, 5.0):
        model = toxicity.fit(frame, known, swap_penalty=penalty)
        got = {r.doc_id: r.s for r in toxicity.with_scores(neutral, model, out="s").collect()}
        gap[penalty], free[penalty] = got[1] - got[2], got
    assert abs(gap[5.0]) < 0.2 * abs(gap[0.0])
    assert free[5.0][1] < free[0.0][1] and free[5.0][3] > 0.7


def test_every_group_of_a_text_is_swapped(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 3 == 0
        who = "muslim women" if toxic else rng.choice(("christian person", "muslim person", "christian person"))
        bad = rng.choice(BAD) if toxic and rng.random() < 0.8 else "here"
        rows.append((i, f"{prose(rng, 6)}. The {who} {bad} said so."))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    asked = documents(spark, [(1, "The muslim said so."), (2, "The christian said so.")])
    gap = {}
    for penalty in (0.0, 5.0):
        model = toxicity.fit(documents(spark, rows), known, swap_penalty=penalty)
        got = {r.doc_id: r.s for r in toxicity.with_scores(asked, model, out="s").collect()}
        gap[penalty] = got[1] - got[2]
    assert abs(gap[5.0]) < 0.2 * abs(gap[0.0])


def test_every_term_of_a_group_is_met():
    text = "Muslim women. A sikh."
    got = [(p, g, words ^ after) for p, g, _, words, after in toxicity.counterfactuals(text, (("women", "men"), ("muslim", "hindu", "sikh")))]
    assert got == [
        (0, 0, {"women", "men"}), (0, 1, {"muslim", "hindu"}), (0, 1, {"muslim", "sikh"}),
        (1, 1, {"sikh", "muslim"}), (1, 1, {"sikh", "hindu"}),
    ]


def test_awkward_rows(spark):
    rows = awkward()
    frame = documents(spark, rows, True)
    known = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame, known)
    got = toxicity.with_scores(frame, model, out="score").collect()
    assert len(got) == len(rows)
    empty = {round(r.score, 12) for r in got if not (r.text or "").strip()}
    assert len(empty) == 1
    blank = toxicity.fit(frame, known.where("doc_id < 0"))
    assert {r.score for r in toxicity.with_scores(frame, blank, out="score").collect()} == {0.5}
    none = frame.where("doc_id < 0")
    assert toxicity.with_scores(none, toxicity.fit(none, known)).count() == 0


def test_objective_is_at_its_least():
    rng = np.random.default_rng(0)
    sets = [sorted(set(rng.integers(0, 30, 6).tolist())) for _ in range(200)]
    labels = np.array([float(3 in s or rng.random() < 0.1) for s in sets])
    pairs = [([3], [4]), ([5, 6], [7])]
    w, b = toxicity.train(sets, labels, pairs, 30, l2=1e-2)

    def loss(w, b):
        z = np.array([w[s].sum() + b for s in sets])
        share = np.where(labels > 0, np.sqrt((labels == 0).sum() / labels.sum()), 1.0)
        share /= share.sum()
        change = np.array([w[q].sum() - w[p].sum() for p, q in pairs])
        return ((np.logaddexp(0, z) - labels * z) * share).sum() + (change**2).sum() / 2 + 5e-3 * (w**2).sum()

    least = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.normal(0, 1e-3, 30), b + rng.normal(0, 1e-3)) >= least - 1e-7
