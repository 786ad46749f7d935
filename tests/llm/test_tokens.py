"""Token counts and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from helpers import awkward, documents

from wattloom.llm import packing, pretokens, token_counts

NAME = token_counts.TOKENIZER


def ids(text):
    return pretokens.tokenizer(NAME).encode(text or "", add_special_tokens=False).ids


def test_runs_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    parts = ["a", "B", "é", "É", "̱", "H", "İ", "Σ", ".", ",", "'s", "'LL", " ", "\n", "\xa0",
             " ", "\x1c", "\x0b", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "1", "中", "..", "x.", "😀"]
    cache = pretokens.Cache(NAME, bytes)
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        words = pretokens.runs(text.encode())
        got = np.frombuffer(b"".join(map(cache.of([words]), words)), "<u4").tolist()
        assert got == ids(text), text


def test_a_full_cache_still_counts_right(monkeypatch):
    monkeypatch.setattr(pretokens, "CACHE_ENTRIES", 3)
    cache = pretokens.Cache(NAME, token_counts.n_ids, {b"one": 1})
    for text in ("one two three four five", "two six seven", "one eight. nine, ten"):
        words = pretokens.runs(text.encode())
        assert sum(map(cache.of([words]), words)) == len(ids(text))


@pytest.mark.parametrize("clashing", [False, True])
def test_counts(spark, clashing):
    rows = awkward()
    got = token_counts.token_counts(documents(spark, rows, clashing), limit=50, entries=10).collect()
    want = sorted(
        (repr(i), len((t or "").encode()), len(ids(t)), len(ids(t)) > 50) for i, t in rows
    )
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_empty_tables(spark):
    empty = documents(spark, [(1, "a")]).where("doc_id < 0")
    assert token_counts.token_counts(empty).count() == 0
    assert packing.pack(empty).count() == 0


def check_packed(rows, got, capacity):
    pieces = []
    for i, t in rows:
        whole = ids(t) + [1]
        for n, at in enumerate(range(0, len(whole), capacity)):
            cut = np.array(whole[at : at + capacity], "<u4")
            pieces.append((repr(i), n, at, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in by_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(p[3] for p in pieces)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, capacity):
    rows = awkward()
    got = packing.pack(documents(spark, rows, True), capacity=capacity).collect()
    sequences, tokens = check_packed(rows, got, capacity)
    assert sequences <= -(-tokens // capacity) * 1.05 + 1


def test_ranks_of_a_frequent_length_are_dealt_over_slots(spark):
    rows = [(i, "one two three") for i in range(400)] + [(1000 + i, "one") for i in range(50)]
    cut = packing.stored(packing.pieces(documents(spark, rows)))
    counts = np.bincount([r["length"] for r in cut.collect()], minlength=11)
    ranks = packing.ranked(cut, "doc_id", counts, most=50).collect()
    for length in np.flatnonzero(counts):
        assert sorted(r["rank"] for r in ranks if r["length"] == length) == list(range(counts[length]))


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_the_histogram_and_is_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, (rng.lognormal(6.5 + seed / 4, 1.0, 20_000)).astype(int) + 1)
    counts = np.bincount(lengths, minlength=4097)
    plan = packing.plan_packing(counts)
    assert not plan.left.any() and (plan.taken == counts).all()
    big = (lengths > 2048).sum()
    least = max(-(-lengths.sum() // 4096), big)
    only = packing.Plan(counts, 4096)
    only.residue()
    assert plan.sequences <= max(only.sequences, least * 1.01)


def test_least_squares_are_non_negative_and_optimal():
    rng = np.random.default_rng(0)
    a = rng.random((12, 40))
    x = np.where(rng.random(40) < 0.8, 0, rng.random(40))
    found = packing.non_negative_least_squares(a, a @ x)
    assert (found >= 0).all() and np.abs(a @ found - a @ x).max() < 1e-6
