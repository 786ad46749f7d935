"""Licence recognition: sentences become identifiers, identifier sequences match ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

# Sentences of licence texts and their identifiers.
SENTENCES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "MITGrant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "MITNotice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT": "MITAsIs",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE": "MITLiability",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDGrant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDSource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDBinary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "you may not use this file except in compliance with the License": "ApacheComply",
    "You may obtain a copy of the License at": "ApacheCopy",
    "http://www.apache.org/licenses/LICENSE-2.0": "ApacheURL",
    "This program is free software": "GPLFree",
    "This library is free software": "LGPLFree",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "GPLTerms",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "LGPLTerms",
    "either version 2 of the License, or (at your option) any later version": "Version2Later",
    "either version 2.1 of the License, or (at your option) any later version": "Version21Later",
    "either version 3 of the License, or (at your option) any later version": "Version3Later",
    "This is free and unencumbered software released into the public domain": "UnlicenseDomain",
    "All rights reserved": "AllRights",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v": "MPLTerms",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/": "MPL2Copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/": "MPL2Copy",
}
# Normalised sentences with a slot for names. A name that ends in a stop cuts its
# sentence, so the part before the last name may be missing.
SLOTS = {
    "^(?:neither the names? of .+ )?nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission$": "BSDEndorse",
    "^the names? of .+ may not be used to endorse or promote products derived from this software without specific prior written permission$": "BSDEndorse",
}
# Licence names in references such as "Licensed under the ...", and identifiers.
NAMES = {
    "MIT License": "MITRef",
    "Apache License, Version 2.0": "Apache2Ref",
    "Apache License 2.0": "Apache2Ref",
    "Apache 2.0 License": "Apache2Ref",
    "GNU General Public License, version 2": "GPL2Ref",
    "GNU General Public License, version 3": "GPL3Ref",
    "GNU General Public License, version 2 or later": "GPL2LaterRef",
    "GNU General Public License, version 3 or later": "GPL3LaterRef",
    "GNU GPL v2": "GPL2Ref",
    "GNU GPL v3": "GPL3Ref",
    "GNU Lesser General Public License, version 2.1": "LGPL21Ref",
    "GNU Lesser General Public License, version 3": "LGPL3Ref",
    "GNU Affero General Public License, version 3": "AGPL3Ref",
    "BSD 2-Clause License": "BSD2Ref",
    "BSD 3-Clause License": "BSD3Ref",
    "ISC License": "ISCRef",
    "Mozilla Public License, version 2.0": "MPL2Ref",
    "Eclipse Public License, version 2.0": "EPL2Ref",
    "Boost Software License, version 1.0": "BSL1Ref",
    "CC0 1.0": "CC0Ref",
    "CC BY 4.0": "CCBYRef",
    "CC BY-SA 4.0": "CCBYSARef",
    "CC BY-ND 4.0": "CCBYNDRef",
    "CC BY-NC 4.0": "CCBYNCRef",
    "CC BY-NC-SA 4.0": "CCBYNCSARef",
    "CC BY-NC-ND 4.0": "CCBYNCNDRef",
}
# Rules in order, longer sequences first; a rule is met by adjacent identifiers.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs", "MITLiability")),
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs")),
    ("ISC", ("ISCGrant",)),
    ("Apache-2.0", ("Apache2Ref", "ApacheComply", "ApacheCopy", "ApacheURL")),
    ("GPL-2.0-or-later", ("GPLFree", "GPLTerms", "Version2Later")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLTerms", "Version3Later")),
    ("LGPL-2.1-or-later", ("LGPLFree", "LGPLTerms", "Version21Later")),
    ("Unlicense", ("UnlicenseDomain",)),
    ("MPL-2.0", ("MPLTerms", "MPL2Copy")),
    ("MIT", ("MITRef",)),
    ("Apache-2.0", ("Apache2Ref",)),
    ("GPL-2.0-or-later", ("GPL2LaterRef",)),
    ("GPL-3.0-or-later", ("GPL3LaterRef",)),
    ("GPL-2.0-only", ("GPL2Ref",)),
    ("GPL-3.0-only", ("GPL3Ref",)),
    ("LGPL-2.1-only", ("LGPL21Ref",)),
    ("LGPL-3.0-only", ("LGPL3Ref",)),
    ("AGPL-3.0-only", ("AGPL3Ref",)),
    ("BSD-2-Clause", ("BSD2Ref",)),
    ("BSD-3-Clause", ("BSD3Ref",)),
    ("ISC", ("ISCRef",)),
    ("MPL-2.0", ("MPL2Ref",)),
    ("EPL-2.0", ("EPL2Ref",)),
    ("BSL-1.0", ("BSL1Ref",)),
    ("CC0-1.0", ("CC0Ref",)),
    ("CC-BY-4.0", ("CCBYRef",)),
    ("CC-BY-SA-4.0", ("CCBYSARef",)),
    ("CC-BY-ND-4.0", ("CCBYNDRef",)),
    ("CC-BY-NC-4.0", ("CCBYNCRef",)),
    ("CC-BY-NC-SA-4.0", ("CCBYNCSARef",)),
    ("CC-BY-NC-ND-4.0", ("CCBYNCNDRef",)),
)
# Other standard wordings; one may stand for several identifiers.
WORDINGS = {
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version": "GPLTerms;Version2Later",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "GPLTerms;Version3Later",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version": "LGPLTerms;Version21Later",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "https://www.apache.org/licenses/LICENSE-2.0": "ApacheURL",
}
SENTENCE_END = r"[.;:!?](?:[ \t\n\r]+|\z)"
REFERENCE = (
    r"^(?:this (?:work|project|software|program|file|document|code|library) is )?"
    r"(?:licensed|released|distributed|published|provided|made available) under (?:the )?(.+)$"
)
# Where a sentence without a full stop ends: lines without letters and digits, such as blank lines or
# bare comment marks, and copyright lines (not a wrapped line that starts with "copyright notice").
PIECE_END = (
    r"\n(?:[^\p{L}\p{N}\n]*\n)+|"
    r"(?i:(?:^|\n)[^\p{L}\p{N}\n©(]*(?:copyright(?:[ \t]*(?:\(c\)|©)|[ \t:,]+(?!(?:(?:notice|holder|owner|law|"
    r"interest|statement)s?|licen[sc]es?|and|or|in|of)\b))|\(c\)[ \t]|©)[^\n]*(?=\n|\z))"
)


def normal(sentence: str) -> str:
    """Lower-case letters and digits with single spaces."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {normal(s): i for s, i in SENTENCES.items()}
KNOWN_NAMES = {normal(s): i for s, i in NAMES.items()}
KNOWN_WORDINGS = KNOWN | {normal(s): i for s, i in WORDINGS.items()}


def _lookup(known: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))


def _identifier(sentence: Column) -> Column:
    """The identifier of a sentence, or several joined by ``;``, or null."""
    text = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    name = F.regexp_replace(F.regexp_extract(text, REFERENCE, 1), " the licen[sc]e$", "")
    return F.coalesce(
        F.try_element_at(_lookup(KNOWN_WORDINGS), text),
        *(F.when(text.rlike(pattern), F.lit(i)) for pattern, i in SLOTS.items()),
        F.try_element_at(_lookup(KNOWN_NAMES), name),
    )


def _or_parts(piece: Column, parts) -> Column:
    """The identifier of a piece known as a whole, else what its parts give."""
    return F.transform(
        F.array(_identifier(piece)),
        lambda whole: F.when(
            whole.isNotNull() | ~F.contains(piece, F.lit("\n")), F.array(whole)
        ).otherwise(parts(piece)),
    )[0]


def _lines(piece: Column) -> Column:
    """A known sentence may stand right below another line, such as a title; else each line counts."""
    lines = F.split(piece, "\n")
    below = F.array_join(F.slice(lines, 2, F.size(lines)), "\n")
    return F.transform(
        F.array(_identifier(below)),
        lambda known: F.when(known.isNotNull(), F.array(_identifier(lines[0]), known)).otherwise(
            F.transform(lines, _identifier)
        ),
    )[0]


def _pieces(sentence: Column) -> Column:
    return F.flatten(F.transform(F.split(sentence, PIECE_END), lambda p: _or_parts(p, _lines)))


def identifiers(text: Column) -> Column:
    """Known identifiers of a text in order. A sentence that is not known as a whole is cut at blank
    lines and copyright lines, and pieces that are not known are looked at line by line, so wrapped
    sentences below a copyright line and licence lines without a full stop are found too."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    found = F.transform(F.split(text, SENTENCE_END), lambda s: _or_parts(s, _pieces))
    known = F.filter(F.flatten(found), lambda i: i.isNotNull())
    return F.flatten(F.transform(known, lambda i: F.split(i, ";")))


def scan_licenses(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Licences of every whole text, one row per row of ``documents``: key, ``identifiers`` (known
    sentences in order), ``licenses`` (in the order of the rules) and ``unmatched`` (identifiers that
    no rule took), lists joined by ``;``.

    Rules are tried in order; what a rule takes is gone for later ones and parts what stands around
    it. Null and empty texts have no licences; repeated rows are each scanned; an empty table gives no
    rows. Other columns are not read. Everything is done where the rows are, without a shuffle.
    """
    rules = F.array(
        *(F.struct(F.lit(n).alias("name"), F.lit(wrapped(ids)).alias("ids")) for n, ids in RULES)
    )
    none = F.array().cast("array<string>")
    rows = documents.select(F.col(key).alias("key"), identifiers(F.col(text)).alias("ids"))
    rows = rows.withColumn(
        "left", F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    )
    matched = F.aggregate(
        rules,
        F.struct(F.col("left").alias("left"), none.alias("found")),
        lambda state, rule: F.struct(
            F.replace(state["left"], rule["ids"], F.lit("|")).alias("left"),
            F.when(
                F.contains(state["left"], rule["ids"]), F.array_append(state["found"], rule["name"])
            )
            .otherwise(state["found"])
            .alias("found"),
        ),
    )
    # Nearly all texts hold no licence sentence; rules run on the others only.
    rows = rows.withColumn("matched", F.when(F.col("left") != "", matched))
    unmatched = F.regexp_extract_all("matched.left", F.lit("<([^>]+)>"), F.lit(1))
    return rows.select(
        F.col("key").alias(key),
        F.concat_ws(";", "ids").alias("identifiers"),
        F.concat_ws(";", F.array_distinct(F.coalesce("matched.found", none))).alias("licenses"),
        F.concat_ws(";", F.coalesce(unmatched, none)).alias("unmatched"),
    )


def wrapped(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _sql() -> str:
    """The scan for an independent engine, without ``WORDINGS`` and ``PIECE_END``: the same on texts
    whose licence sentences end in a stop or fill a line."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    mapping = lambda known: (
        "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in known.items()) + "}"
    )
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    known = lambda v: (
        f"coalesce({mapping(KNOWN)}[{norm.format(v)}], "
        + "".join(
            f"CASE WHEN regexp_matches({norm.format(v)}, {text(p)}) THEN {text(i)} END, "
            for p, i in SLOTS.items()
        )
        + f"{mapping(KNOWN_NAMES)}[regexp_extract({norm.format(v)}, {text(REFERENCE)}, 1)])"
    )
    steps, hits = ["array_to_string(['<' || i || '>' FOR i IN ids], '') AS s0"], []
    for n, (name, ids) in enumerate(RULES):
        steps.append(f"CASE WHEN contains(s{n}, {text(wrapped(ids))}) THEN {text(name)} END AS h{n}")
        steps.append(f"replace(s{n}, {text(wrapped(ids))}, '|') AS s{n + 1}")
        hits.append(f"h{n}")
    last = f"s{len(RULES)}"
    return f"""
WITH sentences AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_split_to_array(coalesce(text, ''), {text(SENTENCE_END)}) AS sentences FROM documents
), one AS (
  SELECT doc_id, row_id, generate_subscripts(sentences, 1) AS pos, unnest(sentences) AS s FROM sentences
), whole AS (
  SELECT *, {known("s")} AS id FROM one
), line AS (
  SELECT doc_id, row_id, pos, 0 AS part, id FROM whole WHERE id IS NOT NULL OR NOT contains(s, chr(10))
  UNION ALL
  SELECT doc_id, row_id, pos, part, {known("l")} AS id FROM (
    SELECT doc_id, row_id, pos, generate_subscripts(string_split(s, chr(10)), 1) AS part,
           unnest(string_split(s, chr(10))) AS l
    FROM whole WHERE id IS NULL AND contains(s, chr(10)))
), found AS (
  SELECT row_id, any_value(doc_id) AS doc_id,
         coalesce(list(id ORDER BY pos, part) FILTER (WHERE id IS NOT NULL), []) AS ids
  FROM line GROUP BY row_id
), matched AS (
  SELECT doc_id, ids, {", ".join(steps)} FROM found
), listed AS (
  SELECT doc_id, ids, {last}, [h FOR h IN [{", ".join(hits)}] IF h IS NOT NULL] AS names FROM matched
)
SELECT doc_id, array_to_string(ids, ';') AS identifiers,
       array_to_string([n FOR n, i IN names IF list_position(names, n) = i], ';') AS licenses,
       array_to_string(regexp_extract_all({last}, '<([^>]+)>', 1), ';') AS unmatched
FROM listed
"""


LICENSE_SQL = _sql()


@query("op6_license_sentences", LICENSE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
