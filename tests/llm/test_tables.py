"""Licences, mixtures and the whole pipeline on small tables, against SQL and by hand."""

import os
import sys

import pytest
from pyspark.sql import functions as F
from helpers import awkward, documents

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tests"))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
import oracle  # noqa: E402

from wattloom.llm import licenses, mixing  # noqa: E402


def by_sql(folder, sql, frame):
    path = f"{folder}/documents.parquet"
    frame.coalesce(1).write.mode("overwrite").parquet(path)
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    cursor = con.execute(sql)
    return oracle.canonical([d[0] for d in cursor.description], cursor.fetchall())


def of(frame):
    return oracle.canonical(frame.columns, [tuple(r) for r in frame.collect()])


def licence_rows():
    full = list(licenses.SENTENCES)
    bsd3 = ". ".join(full[5:9]) + "."
    return [
        (1, f"Prose here.\n{bsd3}\nMore prose."),
        (2, "  * " + ". ".join(full[5:8]) + "."),
        (3, "First line\nReleased under the MIT License\nlast line"),
        (4, "This work is licensed under CC BY-NC 4.0. This work is licensed under CC BY-NC 4.0."),
        (5, ". ".join([full[0] + ":", *full[1:4]]) + "."),
        (6, f"{full[5]}. Something else. {full[6]}. {full[7]}. All rights reserved."),
        (7, f"{full[6]}. {full[5]}. {full[7]}."),
        (8, "licensed under the MIT licence of my own making."),
        (9, "Licensed under the Apache License,\nVersion 2.0. You may obtain a copy of the License at"),
        (10, full[5].replace(" ", "\n   ") + ".\n" + full[6] + ";" + " " + full[7].upper() + "!"),
    ]


def test_licences(spark, folder):
    rows = licence_rows() + awkward()
    frame = documents(spark, rows, True)
    got = licenses.scan_licenses(frame)
    assert of(got) == by_sql(folder, licenses.LICENSE_SQL, frame)
    found = {r.doc_id: r for r in got.collect() if r.doc_id is not None and 1 <= r.doc_id <= 10 and r.identifiers}
    assert [found[i].licenses for i in range(1, 7)] == [
        "BSD-3-Clause", "BSD-2-Clause", "MIT", "CC-BY-NC-4.0", "MIT", "BSD-2-Clause"]
    assert found[6].unmatched == "AllRights"
    assert found[7].licenses == "" and found[7].unmatched == "BSDSource;BSDGrant;BSDBinary"
    assert 8 not in found and found[9].licenses == "Apache-2.0" and found[10].licenses == "BSD-2-Clause"
    assert licenses.scan_licenses(frame.where("doc_id < 0")).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """BSD 2-Clause License

Copyright (c) 2020, Some One

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2.replace("2-Clause", "3-Clause") + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD3_NAMED = BSD3.replace("the copyright holder nor", "Some Company Ltd. nor")
BSD3_AUTHOR = BSD2 + """
3. The name of the author may not be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Copyright 2020 Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
"""
GPL3 = """Copyright (C) 2020 Some One

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")


def test_standard_texts(spark):
    texts = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "ISC": ISC, "Apache-2.0": APACHE,
             "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2}
    ways = [
        lambda t: t,
        lambda t: t.replace("\n", "\r\n"),
        lambda t: "".join(f"# {x}".rstrip() + "\n" for x in t.splitlines()),
        lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\nint main",
        lambda t: t.replace("Some One\n\n", "Some One\n(c) 2021 Another\n"),  # no blank line below
        lambda t: t[t.index("Some One") + 9 :].replace("\n", "", 1),
        lambda t: "<some@one>\n" + t[t.index("Some One") + 9 :].lstrip(),
    ]
    rows = [(100 * i + j, way(t)) for i, t in enumerate(texts.values()) for j, way in enumerate(ways)]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    for i, name in enumerate(texts):
        assert [got[100 * i + j].licenses for j in range(len(ways))] == [name] * len(ways)
        assert all(got[100 * i + j].unmatched == "" for j in range(len(ways)))
    assert got[400].identifiers == "Apache2Ref;ApacheComply;ApacheCopy;ApacheURL"
    assert got[500].identifiers == "GPLFree;GPLTerms;Version3Later"


def test_sentences_with_names(spark, folder):
    texts = [BSD3_NAMED, BSD3_NAMED.replace("Ltd.", "and Others"), BSD3_AUTHOR, MPL, MPL.replace("https", "http")]
    frame = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    assert [got[i].licenses for i in range(5)] == ["BSD-3-Clause"] * 3 + ["MPL-2.0"] * 2
    # The SQL knows sentences that end in a stop or fill a line.
    lines = [" ".join(t[t.index("Redis") if "Redis" in t else 0 :].split()) for t in texts]
    flat = documents(spark, list(enumerate(lines)))
    assert of(licenses.scan_licenses(flat)) == by_sql(folder, licenses.LICENSE_SQL, flat)
    assert [r.licenses for r in licenses.scan_licenses(flat).orderBy("doc_id").collect()] == (
        ["BSD-3-Clause"] * 3 + ["MPL-2.0"] * 2)


def mixture_rows():
    rows = []
    for i in range(400):
        source = "src0" if i % 3 == 0 else f"src{i % 11}"
        lang = ("en", "de", "fr")[i % 7 % 3]
        rows.append((i, "wort " * (i * 37 % 90 + 1), lang, source, 5))
    rows += [(900, None, "en", "src0", 0), (901, "", None, None, 0), (902, "a b", None, "src1", 1)]
    rows += [(903, "", "it", "leer", 0), (904, "lang " * 30_000, "en", "src2", 1), (7, "wort " * 3, "de", "src7", 1)]
    return rows


@pytest.mark.parametrize("ranges_shift", [48, 59])
def test_mixture_equals_sql(spark, folder, ranges_shift):
    frame = documents(spark, mixture_rows(), True)
    got = mixing.mix(frame)
    assert got.columns == [c for c in frame.columns if c != "mixed"] + ["mixed"]
    assert of(got.select("doc_id", "mixed.*")) == by_sql(folder, mixing.MIXING_SQL, frame)
    assert mixing.mix(frame.where("doc_id < 0")).count() == 0


def test_weight_zero_leaves_a_source_out(spark):
    rows = [(i, "a b c d", "en", s, 0) for i, s in enumerate(["x"] * 20 + ["y"] * 20 + ["z"] * 20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")

    def weights(unwanted):
        return lambda d, lang, s: (F.lit(1), F.lit(1), F.when(s == "y", unwanted).otherwise(1))

    flat = {"domain": lambda s: F.lit("all"), "budget_share": 0.5}
    got = mixing.mix(frame, weights=weights(0), **flat).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"x": 15, "z": 15}
    none = mixing.mix(frame, weights=lambda d, lang, s: (F.lit(0),) * 3, **flat)
    assert none.count() == 0
    with pytest.raises(Exception, match="weights must not be negative"):
        mixing.mix(frame, weights=weights(-1), **flat).count()


def slow_shares(children, budget):
    """Fill siblings at equal rates, one token of weight at a time as fractions."""
    given = {}
    open_ = dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if c * total <= w * budget}
        if not full:
            given |= {n: w * budget // total for n, (w, c) in open_.items()}
            break
        n = min(full, key=lambda m: (open_[m][1] / open_[m][0], m))
        given[n] = full[n]
        budget -= full[n]
        del open_[n]
    return given


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [
        ("a", "en", "s1", 10), ("a", "en", "s2", 500), ("a", "de", "s3", 20),
        ("b", "en", "s4", 1000), ("b", "fr", "s5", 5), ("c", "en", "s6", 30),
    ]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    frame = frame.selectExpr("*", "tokens as capacity", "1 as w_domain", "if(lang = 'en', 2, 1) as w_lang", "1 as w_source")
    for budget in (0, 60, 300, 900, 1565, 5000):
        got = {r.source: r.given for r in mixing.budgets(frame, budget).collect()}
        cap = lambda f: sum(t for *p, t in leaves if f(p))
        domains = slow_shares({d: (1, cap(lambda p: p[0] == d)) for d in "abc"}, budget)
        want = {}
        for d in "abc":
            langs = {p[1] for *p, _ in leaves if p[0] == d}
            shares = slow_shares({x: (2 if x == "en" else 1, cap(lambda p: p[:2] == [d, x])) for x in langs}, domains[d])
            for x in langs:
                want |= slow_shares({p[2]: (1, t) for *p, t in leaves if p[:2] == [d, x]}, shares[x])
        assert got == want, budget


def write_tables(spark, folder, rows, labels):
    documents(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")


def test_rows_that_share_an_id_only_both_stay(spark):
    words = [f"w{i}" for i in range(400)]
    one, other = " ".join(words[:200]), " ".join(words[200:])
    rows = [(5, one, "en"), (5, other, "de"), (5, one, "en"), (6, one, "en"), (None, other, "fr"), (7, "c", "en")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = corpus_pipeline.without_near_copies(spark, frame, "").collect()
    assert sorted(map(tuple, got)) == sorted([(5, one, "en"), (5, other, "de"), (7, "c", "en")])


def test_pipeline(spark, folder):
    import random

    from helpers import prose

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        text = prose(rng, rng.randint(40, 120))
        toxic = i % 5 == 0
        text = text.replace(" ", f" {rng.choice(('idiot', 'scum'))} ", 1) if toxic else text
        rows.append((i, text, "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(toxic)))
    copied = rows[1][1]
    rows += [(500 + i, copied, "en", "s1", 1) for i in range(5)]
    rows += [(600, "x " + rows[2][1], "en", "s1", 1), (None, copied, "en", "s1", 1), (None, "alone here", "en", "s1", 1)]
    rows += [(700, None, "en", "s1", 1), (701, "", None, None, None), rows[3]]
    write_tables(spark, folder, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder))
        kept.append([r.doc_id for r in docs.collect()])
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert not set(kept[0]) & {i for i in range(300) if i % 5 == 0}
    assert {i for i in range(300) if i % 5} <= set(kept[0])
    assert kept[1].count(1) == 1 and not set(kept[1]) & set(range(500, 505))
    assert kept[1].count(3) == 1 and kept[1].count(None) == 1 and kept[1].count(700) + kept[1].count(701) == 1
    assert set(kept[2]) < set(kept[1]) and len(kept[2]) > 0.8 * len(kept[1])
    got = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(kept[2])
    empty = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
