"""Repetition measures against a plain version, text by text."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, documents, prose

from wattloom.llm import repetition
from wattloom.llm.spans import Texts

LENGTHS = tuple(range(5, 11))


def slow(text):
    text = text or ""
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    words = [m.group() for m in found]
    seen, later, full = set(), [], 0
    for line in text.split("\n"):
        inside = re.findall(r"[^\x20\x09-\x0D]+", line)
        if inside:
            full += 1
            if line in seen:
                later.append(sum(map(len, inside)))
            seen.add(line)
    covered = {}
    for n in LENGTHS:
        grams = {}
        for i in range(len(words) - n + 1):
            grams.setdefault(tuple(words[i : i + n]), []).append(i)
        covered[n] = {
            i + j for at in grams.values() if len(at) > 1 for i in at for j in range(n)
        }
    spans = []
    for i in sorted(covered[5]):
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), full, len(later),
        sum(later), len(covered[5]), [sum(len(words[i]) for i in covered[n]) for n in LENGTHS],
        [found[a].start() for a, _ in spans], [found[b].end() for _, b in spans],
    )


def awkward_texts():
    rng = random.Random(5)
    line = prose(rng, 12).replace("\n", " ")
    return awkward() + [
        (200, "a b c d e " * 7), (201, "\n".join([line, prose(rng, 30), line, line + " "])),
        (202, "\n\n \n\t\n"), (203, "w " * 40), (204, "x y z\nx y z"), (205, "\x85 \xa0   \x0b\x0c"),
        (206, "#*$%&|<> < > |" * 3), (207, "\n" + line + "\n" + line), (208, prose(rng, 5) * 2),
        (209, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5"), (210, "é à ü ö ß " * 3 + "é à"),
        (211, line + "\n" + line), (212, line), (213, "ab c de f g a bc de f g"),
    ]


def test_against_a_plain_version(spark):
    rows = awkward_texts()
    got = repetition.repetition(documents(spark, rows, clashing=True)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, repr(r[1:]))
    assert sorted((tuple(r) for r in got), key=key) == sorted(
        ((i, *slow(text)) for i, text in rows), key=key
    )


@pytest.mark.parametrize("seed", range(6))
def test_few_words_repeat_often(seed):
    rng = random.Random(seed)
    texts = [
        "".join(rng.choice("abü") + rng.choice((" ", " ", "\n", "\t")) for _ in range(rng.randint(0, 90)))
        for _ in range(30)
    ]
    got = repetition.measure(Texts(pa.array([t.encode() for t in texts])), LENGTHS)
    assert list(zip(*(c.to_pylist() for c in got))) == [slow(t) for t in texts]


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(
        repetition.Rolling, "hashes", lambda self, begin, n: np.zeros(len(begin), np.uint64)
    )
    texts = ["a b c d e f a b c d e", "a b c d e g h", "", "p q r s t u v w x y z"]
    got = repetition.measure(Texts(pa.array([t.encode() for t in texts])), LENGTHS)
    assert list(zip(*(c.to_pylist() for c in got))) == [slow(t) for t in texts]


def test_slices_and_nulls_of_arrow():
    column = pa.array([b"skipped", b"a b", None, b"", b"c", b"rest"], pa.binary()).slice(1, 4)
    got = repetition.measure(Texts(column), LENGTHS)
    assert got[0].to_pylist() == [2, 0, 0, 1]


def test_verdicts(spark):
    rng = random.Random(8)
    # Every word once: nothing repeats but what is repeated on purpose.
    words = [f"{prose(rng, 1).strip()}{i}" for i in range(400)]
    clean, line = " ".join(words[:200]), " ".join(words[200:220])
    rows = [
        (1, clean), (2, "only a few words"), (3, clean + " " + clean), (4, None), (5, ""),
        (6, "\n".join([line] * 6 + words[:100])), (7, clean + "\n" + line + "\n" + " ".join(words[220:])),
        (8, "\n".join(words[:30] + words[:30])), (9, " ".join(words[:9])), (10, " ".join(words[:10])),
    ]
    got = {r.doc_id: r for r in repetition.judged(repetition.repetition(documents(spark, rows))).collect()}
    assert {i for i, r in got.items() if r.kept} == {1, 7, 10}
    assert {i for i, r in got.items() if r.base_failed} == {2, 3, 4, 5, 6, 8, 9}
    assert "repeated_10_grams" in got[3].failed and "repeated_lines" in got[8].failed
    assert got[1].failed == [] and got[4].n_words == 0


def test_empty_table(spark):
    assert repetition.repetition(documents(spark, [])).count() == 0
