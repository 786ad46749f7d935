"""Order MinHash against an independent reading of the method."""

import hashlib
import re
import struct

import pytest
import xxhash
from helpers import awkward, documents

from wattloom.llm import order_minhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def slow(text, k=3, size=2):
    symbols = [s.encode() for s in re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")]
    seen, numbered = {}, []
    for i in range(max(len(symbols) - k + 1, min(len(symbols), 1))):
        h = 42
        for s in symbols[i : i + k]:
            h = xxhash.xxh64_intdigest(s, h)
        h >>= 24
        n = seen[h] = seen.get(h, -1) + 1
        g = xxhash.xxh64_intdigest(struct.pack("<Q", h), 42)
        g = xxhash.xxh64_intdigest(struct.pack("<q", n), g)
        numbered.append((g >> 24) << 24 | i)
    numbered.sort(key=signed)
    parts = []
    for p in range(64):
        at = next((j for j, g in enumerate(numbered) if (signed(g) >> 58) + 32 >= p), 0)
        chosen = [numbered[(at + j) % len(numbered)] for j in range(size)] if numbered else []
        h = 42
        for g in sorted(chosen, key=lambda g: g & 0xFFFFFF):
            h = xxhash.xxh64_intdigest(struct.pack("<Q", g >> 24), h)
        parts.append(format(h, "016x")[-4:])
    return parts


def share(a, b):
    return sum(x == y for x, y in zip(a, b)) / len(a)


@pytest.mark.parametrize("bucket_rows", [7, 1000])
def test_against_the_method(spark, bucket_rows):
    rows = awkward()
    rows = [r for r in rows if r[0] is not None]
    got = order_minhash.edit_sensitivity(documents(spark, rows, True), bucket_rows=bucket_rows).collect()
    order = sorted(rows, key=lambda r: (-r[0], (r[1] or "").encode()))
    none = slow("")
    want = []
    for at, (i, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = slow(text), slow(edited), slow(after)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a if text.split() else none), share(a, b), share(a, c)))
    assert len(got) == len(want)
    digest = lambda rows: sorted((r[0], r[1], r[2], round(r[4], 6), round(r[5], 6)) for r in rows)
    assert digest((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got) == digest(want)
    by_id = {w[0]: w[3] for w in want if (w[0], None) not in rows and rows.count((w[0], w[3])) < 2}
    texts = {i: t for i, t in rows}
    for r in got:
        if (texts[r.doc_id] or "").split():
            assert r.fingerprint == by_id[r.doc_id]


def test_small_tables(spark):
    empty = documents(spark, [(1, "a")]).where("doc_id < 0")
    assert order_minhash.edit_sensitivity(empty).count() == 0
    lone = order_minhash.edit_sensitivity(documents(spark, [(None, "a b c d")])).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    extremes = [(-(1 << 63), "a b"), ((1 << 63) - 1, "c d"), (0, "e f"), (None, "g h")]
    got = order_minhash.edit_sensitivity(documents(spark, extremes), bucket_rows=1).collect()
    edits = {r.doc_id: r.edited_sha256 for r in got}
    assert edits[0] == hashlib.sha256(b"e a").hexdigest()
    assert edits[None] == hashlib.sha256(b"g c").hexdigest()
    assert edits[-(1 << 63)] == hashlib.sha256(b"a g").hexdigest()


def test_order_matters(spark):
    words = [f"w{i}" for i in range(200)]
    moved = words[100:] + words[:100]
    rows = [(1, " ".join(words)), (2, " ".join(moved)), (3, " ".join(words[:190]))]
    frame = order_minhash.with_fingerprint(documents(spark, rows), "text", "fp", k=1)
    fp = {r.doc_id: [r.fp[i : i + 4] for i in range(0, 256, 4)] for r in frame.collect()}
    # The same words in another order: parts whose tuple straddles the cut differ.
    assert share(fp[1], fp[2]) < 0.75 < share(fp[1], fp[3])
