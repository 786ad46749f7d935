"""SimHash groups against brute force."""

import random

import numpy as np
import pytest
import xxhash
from helpers import awkward, documents, prose

from wattloom.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def slow_groups(values, radius=3):
    owner = list(range(len(values)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                owner[b] = a
    return [root(i) for i in range(len(values))]


def test_groups(spark):
    rng = random.Random(5)
    rows = awkward()
    base = prose(rng, 300).split()
    for i in range(25):
        copy = list(base)
        copy[rng.randrange(300)] = "geändert"
        rows.append((200 + i, " ".join(copy)))
    got = simhash.near_duplicates(documents(spark, rows, True)).collect()
    values = [slow_fingerprint(t) for _, t in rows]
    groups = slow_groups(values)
    least = {}
    for (i, _), g in zip(rows, groups):
        least[g] = min(least.get(g, 1 << 62), 1 << 62 if i is None else i)
    want = sorted(
        (repr(i), format(v, "016x"), None if least[g] == 1 << 62 else least[g])
        for (i, _), v, g in zip(rows, values, groups)
    )
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert any(r.component_id != r.doc_id for r in got if r.doc_id and r.doc_id > 200)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [(1, "a")]).where("doc_id < 0")).count() == 0


def near(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("part", [4096, 16])
def test_links_find_every_pair_also_across_parts(spark, part):
    rng = random.Random(part)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        values.add(near(rng, v, rng.randint(1, 5)))
    centre = rng.getrandbits(64)
    values |= {near(rng, centre, rng.randint(0, 3)) for _ in range(120)}
    chain = rng.getrandbits(64)
    for _ in range(20):
        chain = near(rng, chain, 3)
        values.add(chain)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    edges = simhash.links(nodes, part=part)
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    groups = {}
    for v, g in zip(signed, slow_groups(values)):
        groups.setdefault(g, []).append(v)
    for members in groups.values():
        assert {found.get(v, v) for v in members} == {min(members)}


def test_tree_walks_only_edges_within_the_radius_and_loses_nothing():
    rng = random.Random(2)
    values = [rng.getrandbits(12) for _ in range(200)]
    tree = simhash.BKTree(dict.fromkeys(values))
    asked = [rng.getrandbits(12) for _ in range(50)]
    found = {(tree.values[n], asked[i]) for n, hit in tree.near(asked, 2) for i in hit.tolist()}
    assert found == {(v, a) for v in values for a in asked if (v ^ a).bit_count() <= 2}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 80)]
    owner = {n: n for e in edges for n in e}

    def root(n):
        while owner[n] != n:
            n = owner[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        owner[b] = a
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.component for r in simhash.components(frame).collect()}
    assert all(found.get(n, n) == root(n) for n in owner)
