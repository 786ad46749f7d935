"""Small tables for the operators of the text subpackage."""

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns with names that the operators use inside.
CLASHING = "key string, fp bigint, rank int, length bigint, score double, mixed string, n int"
WORDS = [a + b for a in ("ka", "lo", "mi", "Re", "su", "ta") for b in ("n", "rel", "st", "", "vo")]


def prose(rng, n):
    return " ".join(
        rng.choice(WORDS) + rng.choice(("", "", "", ",", ".", ".\n")) for _ in range(n)
    )


def documents(spark, rows, clashing=False):
    """rows: (doc_id, text) or full rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "s1", None) for r in rows]
    frame = spark.createDataFrame(full, DOCUMENTS).repartition(3)
    if clashing:
        from pyspark.sql import functions as F

        frame = frame.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (
            c.split() for c in CLASHING.split(", "))))
    return frame


def awkward(seed=3, n=40):
    """Documents with nulls, empty, blank, repeated and very long texts, and copies."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(n)]
    text = rows[5][1]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, text), (104, text), (105, text + " Zusatz")]
    rows += [(106, "é ü <|endoftext|> İ ß 中文 😀 a̱H̱"), (107, "x" * 30_000), (108, prose(rng, 9000))]
    rows += [(109, "one"), (110, "one two"), (None, "no id"), (3, rows[3][1])]
    return rows
