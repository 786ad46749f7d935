"""Repetition coverage: characters inside repeated n-grams of several lengths and repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, slices, table, utf8
from .spans import BETWEEN_BLANKS, Texts, lookup, numbered

# Published limits for web text, in per cent of the characters in words that may lie
# in repeated n-grams, in repeated lines, and of the lines that may be repeated.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_CHARS_LIMIT = 20
LINES_LIMIT = 30
# The base rules.
FEWEST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
SYMBOLS = ~lookup(b"#*$%&|<>")
NEWLINE = 10

_ODD = 0x9E3779B97F4A7C15  # base of the rolling hash, odd so that it has an inverse
_INVERSE = pow(_ODD, -1, 1 << 64)

MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint,"
    " dup_line_chars bigint, n_repeat_words bigint, repeat_chars array<bigint>,"
    " span_begin array<bigint>, span_end array<bigint>"
)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    z = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Rolling:
    """Rolling hashes of all windows of words, of any length, from one running sum."""

    def __init__(self, words: np.ndarray, owners: np.ndarray):
        self.words, self.owners = words, owners
        powers = np.full(len(words) + 1, _ODD, np.uint64)
        powers[0] = 1
        self.sums = np.concatenate(
            (np.zeros(1, np.uint64), np.cumsum(_mixed(words) * np.cumprod(powers)[:-1]))
        )
        back = np.full(len(words) + 1, _INVERSE, np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)
        self.seeds = _mixed(owners + (1 << 40))

    def hashes(self, begin: np.ndarray, n: int) -> np.ndarray:
        """Of the windows of ``n`` words that begin here; windows of two texts differ."""
        value = (self.sums[begin + n] - self.sums[begin]) * self.back[begin]
        return _mixed(value) ^ self.seeds[begin]

    def whole(self, begin: np.ndarray, n: int) -> np.ndarray:
        """Those of the windows that end in the text they begin in."""
        begin = begin[begin + n <= len(self.words)]
        return begin[self.owners[begin] == self.owners[begin + n - 1]]

    def repeated(self, begin: np.ndarray, n: int) -> np.ndarray:
        """Those of the windows that their text holds twice or more, first included."""
        keys = self.hashes(begin, n)
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            return begin[:0]
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        chosen = twice[at] == keys
        begin, keys = begin[chosen], keys[chosen]
        order = np.argsort(keys, kind="stable")
        begin, keys = begin[order], keys[order]
        alike = keys[1:] == keys[:-1]
        equal = self.owners[begin[1:]] == self.owners[begin[:-1]]
        for i in range(n):
            equal &= self.words[begin[1:] + i] == self.words[begin[:-1] + i]
        if (alike & ~equal).any():  # two windows share a hash by chance: compare the words
            rows = [self.owners[begin], *(self.words[begin + i] for i in range(n))]
            order = np.lexsort(rows[::-1])
            begin = begin[order]
            equal = np.all([r[order][1:] == r[order][:-1] for r in rows], axis=0)
        same = np.concatenate(([False], equal, [False]))
        return np.sort(begin[same[1:] | same[:-1]])


def _covered(begin: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which words lie in the windows."""
    steps = np.zeros(size + 1, np.int64)
    steps[begin] += 1
    np.subtract.at(steps, begin + n, 1)
    return np.cumsum(steps[:-1]) > 0


def _lists(values: np.ndarray, owners: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)))


def measure(texts: Texts, lengths: tuple[int, ...]) -> list[pa.Array]:
    """The columns of ``MEASURES`` for some texts."""
    n, data = len(texts), texts.data

    def by_text(owners: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owners, weights, minlength=n).astype(np.int64)

    inside = BETWEEN_BLANKS[data]
    begins, ends = texts.words(inside)
    points = texts.code_points()
    chars = points[ends] - points[begins]
    owners = texts.owner(begins)
    words = numbered(data[inside], ends - begins).indices.to_numpy()
    symbols = by_text(texts.owner(np.flatnonzero(SYMBOLS[data])))

    # Lines without their line ends; empty ones do not count, so it does not matter whose they are.
    breaks = np.flatnonzero(data == NEWLINE)
    firsts = np.sort(np.concatenate((texts.offsets[:-1], breaks + 1)))
    lasts = np.concatenate((firsts[1:], [len(data)]))
    running = np.concatenate(([0], np.cumsum(data != NEWLINE)))
    line_words = np.searchsorted(begins, lasts) - np.searchsorted(begins, firsts)
    held = np.concatenate(([0], np.cumsum(chars)))
    line_chars = held[np.searchsorted(begins, lasts)] - held[np.searchsorted(begins, firsts)]
    lines = numbered(data[data != NEWLINE], running[lasts] - running[firsts]).indices.to_numpy()
    full = line_words > 0
    of = texts.owner(firsts[full])
    order = np.lexsort((lines[full], of))  # stable: later copies come later
    again = np.zeros(len(order), bool)
    a, b = of[order], lines[full][order]
    again[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])

    rolling = Rolling(words, owners)
    repeat_chars = []
    repeat_words = np.zeros(n, np.int64)
    spans = (np.zeros(0, np.int64),) * 3
    candidates = np.arange(len(words))
    done = 0
    for length in sorted({WINDOW, *lengths}):
        # A window can only be repeated if every shorter window in it is.
        marked = np.zeros(len(words) + 1, bool)
        marked[candidates] = True
        inner = rolling.whole(candidates, length)
        if done:
            inner = inner[marked[inner + length - done]]
        candidates, done = rolling.repeated(inner, length), length
        covered = _covered(candidates, length, len(words))
        if length == WINDOW:
            repeat_words = by_text(owners[covered])
            edge = np.flatnonzero(covered)
            new = np.ones(len(edge), bool)
            new[1:] = (edge[1:] != edge[:-1] + 1) | (owners[edge[1:]] != owners[edge[:-1]])
            last = np.concatenate((new[1:], [True])) if len(edge) else new
            start = texts.offsets[owners[edge[new]]]
            spans = (
                owners[edge[new]],
                points[begins[edge[new]]] - points[start],
                points[ends[edge[last]]] - points[start],
            )
        if length in lengths:
            repeat_chars.append(by_text(owners[covered], chars[covered]))
    flat = np.stack(repeat_chars, 1).ravel()
    return [
        *map(pa.array, (by_text(owners), by_text(owners, chars), symbols, by_text(of))),
        *map(pa.array, (by_text(of[again]), by_text(of[again], line_chars[full][again]))),
        pa.array(repeat_words),
        _lists(flat, np.repeat(np.arange(n), len(lengths)), n),
        _lists(spans[1], spans[0], n),
        _lists(spans[2], spans[0], n),
    ]


def repetition(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lengths: tuple[int, ...] = tuple(NGRAM_LIMITS),
) -> DataFrame:
    """One row per row of ``docs``: its key and measures of what its whole text repeats.

    Words are runs of anything but blanks and U+0009 to U+000D; characters are code points.
    ``n_words``, ``word_chars`` (in words), ``n_symbols`` (of ``#*$%&|<>``), ``n_lines`` (pieces
    between line feeds that hold a word), ``n_dup_lines`` and ``dup_line_chars`` (those equal to an
    earlier line, and their characters in words), ``n_repeat_words`` (words in windows of five
    found twice or more, first included), ``repeat_chars`` (for each of ``lengths``, ascending, the
    characters of words in repeated windows of so many words), ``span_begin``/``span_end`` (the runs of
    the words in repeated windows of five, as code points from the start of the text).

    Windows are found by rolling hashes and then compared word by word, so no measure is a guess.
    Null and empty texts have zeros and no spans; a text shorter than a window repeats none. Rows with
    a repeated or null key are measured each for itself; other columns are ignored, whatever their
    names. Nothing is shuffled, and a task holds some 4 MB of text at a time, or one longer text.
    """
    lengths = tuple(sorted(set(lengths)))
    columns = ["key", *(c.split()[0] for c in MEASURES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            measured = measure(Texts(batch.column("body")), lengths)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *measured], columns)

    rows = docs.select(F.col(key).cast("bigint").alias("key"), utf8(text).alias("body"))
    return rows.mapInArrow(run, f"key bigint, {MEASURES}").withColumnRenamed("key", key)


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (n < FEWEST_WORDS) | (repeated * 100 > n * MOST_REPEATED)


def failed_rules(limits: dict[int, int] = NGRAM_LIMITS) -> Column:
    """The names of the rules that a measured text breaks, in a fixed order."""
    chars = F.col("word_chars")
    rules = [
        (f"repeated_{n}_grams", F.col("repeat_chars")[i] * 100 > chars * limits[n])
        for i, n in enumerate(sorted(limits))
    ]
    rules.append(("repeated_line_chars", F.col("dup_line_chars") * 100 > chars * LINE_CHARS_LIMIT))
    rules.append(("repeated_lines", F.col("n_dup_lines") * 100 > F.col("n_lines") * LINES_LIMIT))
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules)))


def judged(measured: DataFrame) -> DataFrame:
    """Adds ``base_failed``, ``failed`` (names of broken rules) and ``kept``: neither."""
    return (
        measured.withColumn("base_failed", base_failed())
        .withColumn("failed", failed_rules())
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    )


def _sql() -> str:
    over = " OR ".join(
        f"100 * coalesce(c{n}, 0) > {most} * word_chars" for n, most in NGRAM_LIMITS.items()
    )
    windows = " UNION ALL ".join(
        f"SELECT r, {n} AS n, unnest(range(1, len(w) - {n - 2})) AS i,"
        f" unnest([array_to_string(w[x:x + {n - 1}], ' ') FOR x IN range(1, len(w) - {n - 2})]) AS g FROM t"
        for n in NGRAM_LIMITS
    )
    chars = ", ".join(f"sum(length(word)) FILTER (n = {n}) AS c{n}" for n in NGRAM_LIMITS)
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
windows AS ({windows}),
twice AS (SELECT r, n, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, n, g) > 1),
covered AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM twice),
repeats AS (
  SELECT r, count(*) FILTER (n = {WINDOW}) AS n_repeat_words, {chars}
  FROM covered JOIN word USING (r, i) GROUP BY r
), split AS (
  SELECT r, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i,
         unnest(string_split(body, chr(10))) AS line FROM t
), line AS (
  SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS later,
         length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
  FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (later) AS n_dup_lines,
         coalesce(sum(chars) FILTER (later), 0) AS dup_line_chars FROM line GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, repeats.*
  FROM t LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)
), v AS (
  SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
         {over} OR 100 * dup_line_chars > {LINE_CHARS_LIMIT} * word_chars
         OR 100 * n_dup_lines > {LINES_LIMIT} * n_lines AS over
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT over AS kept FROM v
"""


@query("op11_repetition_coverage", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(repetition(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )
