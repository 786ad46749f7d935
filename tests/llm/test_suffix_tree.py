"""Suffix-tree scores against a plain dictionary version."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

from wattloom.llm import suffix_tree

END = b"\n"


def slow(rows, held, share, prior, least_gain):
    texts = [(t or "").encode().lower().split() + [END] for _, t in rows]
    train = [t for t, h in zip(texts, held) if not h]
    one = Counter(w for t in train for w in t)
    n, different = sum(one.values()), len(one)
    least = share * n
    singles = {w for w, c in one.items() if c >= max(1.0, least) and w != END}
    pair_n = Counter((a, b) for t in train for a, b in zip(t, t[1:]) if a in singles and b in singles)
    pairs = {p for p, c in pair_n.items() if c >= max(2.0, least)}
    after_one, after_two = Counter(), Counter()
    for t in train:
        for i, w in enumerate(t):
            if i >= 1 and t[i - 1] in singles:
                after_one[t[i - 1], w] += 1
            if i >= 2 and (t[i - 2], t[i - 1]) in pairs:
                after_two[t[i - 2], t[i - 1], w] += 1
    root = lambda w: (one[w] + 1) / (n + different + 1)
    single = lambda a, w: (after_one[a, w] + prior * root(w)) / (one[a] + prior)
    gain = Counter()
    for (a, w), c in after_one.items():
        gain[a,] += c * math.log((c - 1 + prior * root(w)) / (one[a] - 1 + prior) / root(w))
    for (a, b, w), c in after_two.items():
        p = single(b, w)
        gain[a, b] += c * math.log((c - 1 + prior * p) / (pair_n[a, b] - 1 + prior) / p)
    kept = {s for s, g in gain.items() if g >= least_gain}
    kept -= {s for s in kept if len(s) == 2 and (s[1],) not in kept}
    out = []
    for t in texts:
        base = score = known = 0
        for i, w in enumerate(t):
            p = root(w)
            base += math.log10(p)
            known += one[w] > 0
            if i >= 1 and (t[i - 1],) in kept:
                p = single(t[i - 1], w)
            if i >= 2 and (t[i - 2], t[i - 1]) in kept:
                p = (after_two[t[i - 2], t[i - 1], w] + prior * p) / (pair_n[t[i - 2], t[i - 1]] + prior)
            score += math.log10(p)
        out.append((len(t), known, n, base, score))
    return out, kept


@pytest.mark.parametrize("ranges, tokens", [(1, 1 << 20), (300, 500)])
def test_against_dictionaries(spark, monkeypatch, ranges, tokens):
    rng = random.Random(9)
    rows = awkward(n=30)
    phrase = ["alpha beta gamma delta", "one two three four", "beta gamma end now"]
    rows += [(300 + i, " ".join(rng.choices(phrase + ["x", "y", "z"], k=rng.randint(1, 40)))) for i in range(80)]
    rows = [r for r in rows if r[0] is not None]
    held = [i % 7 == 2 for i, _ in rows]
    monkeypatch.setattr(suffix_tree, "TOKENS_PER_RANGE", max(1, 14_000 // ranges))
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", tokens)
    want, kept = slow(rows, held, 0.002, 20.0, 2.0)
    assert any(len(s) == 2 for s in kept) and any(len(s) == 1 for s in kept)
    got = suffix_tree.suffix_tree_scores(
        documents(spark, rows, True), F.col("doc_id") % 7 == 2, share=0.002, prior=20.0, least_gain=2.0
    ).collect()
    digest = lambda i, h, v: (i, h, *v[:3], round(v[3], 6), round(v[4], 6))
    assert sorted(
        digest(r.doc_id, r.held_out, (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
        for r in got
    ) == sorted(digest(i, h, v) for (i, _), h, v in zip(rows, held, want))


def test_next_word_probabilities_add_up_to_less_than_one(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("a b c d".split(), k=30))) for i in range(60)]
    asked = [(1000 + j, f"a b {w}") for j, w in enumerate("a b c d unseen".split())] + [(2000, "a b")]
    got = suffix_tree.suffix_tree_scores(
        documents(spark, rows + asked), F.col("doc_id") >= 1000, share=0.001, prior=5.0, least_gain=-1e9
    ).collect()
    score = {r.doc_id: r.score for r in got}
    # The end follows each; what is left of 10 ** (difference) is P(w | a b) * P(end | w, ...).
    assert all(score[i] < 0 for i in score)
    assert score[1004] < min(score[1000 + j] for j in range(4))


def test_without_training_and_empty(spark):
    frame = documents(spark, [(1, "a b"), (None, None)])
    got = suffix_tree.suffix_tree_scores(frame, F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert suffix_tree.suffix_tree_scores(frame.where("doc_id = 7"), F.lit(False)).count() == 0


def test_what_precedes_one_word_is_spread_over_ranges(spark):
    rows = [(i, f"w{i} the") for i in range(2000)]
    table = suffix_tree.encoded(documents(spark, rows).coalesce(1), "text", "doc_id", F.lit(False)).toArrow()
    chunk = suffix_tree.Chunk(table.to_batches()[0], 0)
    at = chunk.starts + 1  # every "the", each behind another word
    context, item = suffix_tree._contexts(chunk, at, 1)
    assert len(set(chunk.tokens[at])) == 1 and len(np.unique(item)) == len(np.unique(context)) == 2000
    for keys in (context, item):
        sizes = np.bincount(suffix_tree._range(keys, 8), minlength=8)
        assert sizes.min() > 200 and sizes.max() < 300


def slow_tree(rows, held, least, prior, least_gain):
    """Scores by a tree of any depth, and the retained contexts."""
    texts = [(t or "").encode().lower().split() + [END] for _, t in rows]
    train = [t for t, h in zip(texts, held) if not h]
    one = Counter(w for t in train for w in t)
    n, different = sum(one.values()), len(one)
    root = lambda w: (one[w] + 1) / (n + different + 1)
    seen, after, kept = Counter(), Counter(), set()

    def p(context, w):
        if not context:
            return root(w)
        return (after[context, w] + prior * p(context[1:], w)) / (seen[context] + prior)

    for k in range(1, max(map(len, texts))):
        gain, new = Counter(), Counter()
        for t in train:
            for i in range(k, len(t)):
                context = tuple(t[i - k : i])
                if k == 1 or context[1:] in kept:
                    seen[context] += 1
                    new[context, t[i]] += 1
        after.update(new)
        for (context, w), c in new.items():
            q = p(context[1:], w)
            gain[context] += c * math.log((c - 1 + prior * q) / (seen[context] - 1 + prior) / q)
        more = {c for c, g in gain.items() if seen[c] >= least and g >= least_gain}
        if not more:
            break
        kept |= more
    out = []
    for t in texts:
        score = 0
        for i, w in enumerate(t):
            k = 0
            while k < i and tuple(t[i - k - 1 : i]) in kept:
                k += 1
            score += math.log10(p(tuple(t[i - k : i]), w))
        out.append(score)
    return out, kept


@pytest.mark.parametrize("tokens", [1 << 19, 400])
def test_tree_grows_beyond_pairs_by_absolute_counts(spark, monkeypatch, tokens):
    rng = random.Random(5)
    rows = awkward(n=20)
    # What follows "three" depends on up to four words; copies; and much else, so these are a small share.
    phrases = ["p one two three pp", "q one two three qq", "s two three ss", "t three tt"]
    rows += [(300 + i, f"{rng.choice(phrases)} {rng.choice('xyz')}") for i in range(160)]
    rows += [(500 + i, " ".join(f"u{rng.randrange(3000)}" for _ in range(200))) for i in range(40)]
    rows += [(600 + i, "the very same line again and again until it ends") for i in range(14)]
    rows = [r for r in rows if r[0] is not None]
    held = [i % 7 == 2 for i, _ in rows]
    monkeypatch.setattr(suffix_tree, "TOKENS_PER_RANGE", 700)
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", tokens)
    want, kept = slow_tree(rows, held, 10, 20.0, 2.0)
    assert max(map(len, kept)) >= 4 and (b"p", b"one", b"two", b"three") in kept
    got = suffix_tree.suffix_tree_scores(
        documents(spark, rows, True), F.col("doc_id") % 7 == 2, prior=20.0, least_gain=2.0
    ).collect()
    digest = lambda i, v: (i, round(v, 6))
    assert sorted(digest(r.doc_id, r.score) for r in got) == sorted(
        digest(i, v) for (i, _), v in zip(rows, want)
    )


def test_late_levels_do_not_hold_the_corpus(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(f"u{rng.randrange(300)}" for _ in range(300))) for i in range(40)]
    rows += [(100 + i, f"v{rng.randrange(300)} the very same line again and again until it ends") for i in range(14)]
    tables = []

    def recorded(frame, n, store=suffix_tree._stored_by_chunk):
        tables.append(store(frame, n))
        read = [r.tokens for r in tables[-1].select("tokens").collect()] if "tokens" in frame.columns else None
        sizes.append(read and sum(len(suffix_tree.loosened(t, "<u4")) for t in read))
        return tables[-1]

    sizes = []
    monkeypatch.setattr(suffix_tree, "_stored_by_chunk", recorded)
    want, kept = slow_tree(rows, [False] * len(rows), 10, 20.0, 0.05)
    assert max(map(len, kept)) >= 8
    got = suffix_tree.suffix_tree_scores(documents(spark, rows), F.lit(False), prior=20.0, least_gain=0.05)
    assert {r.doc_id: round(r.score, 6) for r in got.collect()} == {
        i: round(v, 6) for (i, _), v in zip(rows, want)
    }
    chunks, *narrowed = [s for s in sizes if s is not None]
    assert chunks == 40 * 301 + 14 * 12
    assert len(narrowed) >= 2 and all(0 < s < chunks / 5 for s in narrowed)


def test_grouped_keys_that_share_their_high_bits():
    rng = np.random.default_rng(2)
    high = rng.integers(0, 1 << 20, 50).astype(np.uint64) << np.uint64(44)
    for keys in (rng.choice(high, 4000) + rng.integers(0, 9, 4000).astype(np.uint64), high[:0], high[[3, 3]]):
        known, of = suffix_tree.grouped(keys)
        want, place = np.unique(keys, return_inverse=True)
        assert known.tolist() == want.tolist() and of.tolist() == place.tolist()


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_subtrees_grow_several_words_at_once(spark, monkeypatch, most):
    rng = random.Random(11)
    rows = [(i, " ".join(f"u{rng.randrange(300)}" for _ in range(300))) for i in range(40)]
    line = "the very same line again and again until it ends or goes on for so long that many levels are open"
    rows += [(100 + i, f"v{rng.randrange(300)} {line}") for i in range(14)]
    rows += [(200 + i, f"{rng.choice(['p q', 'r q', 's'])} very same line again {rng.choice('xyz')}") for i in range(60)]
    rows += [(300 + i, None) for i in range(3)]
    held = [i % 9 == 2 for i, _ in rows]
    states = []

    def recorded(frame, n, store=suffix_tree._stored_by_chunk):
        states.append("alive" in frame.columns)
        return store(frame, n)

    monkeypatch.setattr(suffix_tree, "_stored_by_chunk", recorded)
    monkeypatch.setattr(suffix_tree, "CONTEXT_WORDS", most)
    monkeypatch.setattr(suffix_tree, "SUBTREE_WORDS", 500)
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", 2000)
    want, kept = slow_tree(rows, held, 10, 20.0, 0.05)
    deepest = max(map(len, kept))
    assert deepest >= 9
    got = suffix_tree.suffix_tree_scores(
        documents(spark, rows), F.col("doc_id") % 9 == 2, prior=20.0, least_gain=0.05
    )
    assert sorted((r.doc_id, round(r.score, 6)) for r in got.collect()) == sorted(
        (i, round(v, 6)) for (i, _), v in zip(rows, want)
    )
    if most == 1 << 20:
        assert sum(states) < 1.5 * deepest  # a level at a time takes two for each
