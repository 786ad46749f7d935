"""Toxicity classifier, regularised by swapping identity terms."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import query, slices, table, utf8, worker_state

#: Groups of identity terms that may replace one another.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("girl", "boy"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("deaf", "blind", "disabled", "autistic"),
    ("young", "old", "elderly", "teenage"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "turkish"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
DIMENSIONS = 1 << 20
CACHE_ENTRIES = 400_000


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its five-letter parts, word ends marked."""
    marked = f"^{word}$"
    grams = {marked, *(marked[i : i + 5] for i in range(len(marked) - 4))}
    return tuple({zlib.crc32(g.encode()) % DIMENSIONS for g in grams})


class Features:
    """Presence features of texts, with a bounded cache of words for one worker.

    With ``kept`` (feature -> column) only kept features are returned, as columns.
    """

    def __init__(self, kept: dict[int, int] | None = None):
        self.kept, self.known = kept, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            found = word_features(word)
            if self.kept is not None:
                found = tuple(self.kept[f] for f in found if f in self.kept)
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[word] = found
        return found

    def of_words(self, words: set[str]) -> set[int]:
        known = self.known.get
        out: set[int] = set()
        for word in words:
            found = known(word)
            if found is None:
                found = self.of_word(word)
            if found:
                out.update(found)
        return out

    def of(self, text: str) -> set[int]:
        return self.of_words(set(WORD.findall(text.lower())))


def counterfactuals(
    text: str, groups: tuple[tuple[str, ...], ...]
) -> Iterator[tuple[int, int, int, set, set]]:
    """(sentence, group, step, words, words after the swap) for each group a sentence mentions and each
    other term of it: every term is replaced by the one so many steps further in its group."""
    swaps = [
        (n, step, {t: g[(i + step) % len(g)] for i, t in enumerate(g)})
        for n, g in enumerate(groups)
        for step in range(1, len(g))
    ]
    terms = {t for g in groups for t in g}
    for place, sentence in enumerate(SENTENCE.findall(text.lower())):
        words = set(WORD.findall(sentence))
        if words.isdisjoint(terms):
            continue
        for n, step, swap in swaps:
            if not words.isdisjoint(swap):
                yield place, n, step, words, {swap.get(w, w) for w in words}


@dataclass
class Model:
    """Kept features, their weights and the intercept."""

    weights: dict[int, float] = field(default_factory=dict)
    intercept: float = 0.0


def _rows(sets: list[list[int]], columns: int) -> tuple[np.ndarray, np.ndarray]:
    index = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return index, np.fromiter((c for s in sets for c in s), np.int64, len(index))


def train(
    sets: list[list[int]],
    labels: np.ndarray,
    pairs: list[tuple[list[int], list[int]]],
    columns: int,
    swap_penalty: float = 1.0,
    l2: float = 3e-5,
    rounds: int = 200,
    memory: int = 10,
) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the log loss (the rarer label weighs more, by the root of
    the ratio), plus ``l2``, plus ``swap_penalty`` times the mean squared change of the logit
    between a sentence and its counterfactual. Limited-memory quasi-Newton steps."""
    row, col = _rows(sets, columns)
    minus_row, minus = _rows([a for a, _ in pairs], columns)
    plus_row, plus = _rows([b for _, b in pairs], columns)
    n, m = len(sets), max(1, len(pairs))
    ones = float(labels.sum())
    rare = np.sqrt((n - ones) / ones) if 0 < ones < n else 1.0
    share = np.where(labels > 0, rare, 1.0)
    share = share / share.sum()

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x[:-1]
        z = np.bincount(row, weights=w[col], minlength=n) + x[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) * share
        change = np.bincount(plus_row, weights=w[plus], minlength=m) - np.bincount(
            minus_row, weights=w[minus], minlength=m
        )
        pull = 2 * swap_penalty * change / m
        gradient = l2 * w + np.bincount(col, weights=error[row], minlength=columns)
        gradient += np.bincount(plus, weights=pull[plus_row], minlength=columns)
        gradient -= np.bincount(minus, weights=pull[minus_row], minlength=columns)
        value = ((np.logaddexp(0, z) - labels * z) * share).sum()
        value += swap_penalty * (change**2).sum() / m + l2 / 2 * float(w @ w)
        return float(value), np.append(gradient, error.sum())

    x = np.zeros(columns + 1)
    value, gradient = objective(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, used = -gradient, []
        for s, g in reversed(steps):
            a = (s @ direction) / (g @ s)
            used.append(a)
            direction = direction - a * g
        if steps:
            s, g = steps[-1]
            direction = direction * ((s @ g) / (g @ g))
        for (s, g), a in zip(steps, reversed(used)):
            direction = direction + s * (a - (g @ direction) / (g @ s))
        length, slope = 1.0, float(gradient @ direction)
        while True:
            trial = x + length * direction
            new, new_gradient = objective(trial)
            if new <= value + 1e-4 * length * slope or length < 1e-10:
                break
            length /= 2
        s, g = trial - x, new_gradient - gradient
        if s @ g > 1e-12:
            steps = [*steps[1 - memory :], (s, g)]
        small = value - new < 1e-9 * max(1.0, value)
        x, value, gradient = trial, new, new_gradient
        if small:
            break
    return x[:-1], float(x[-1])


def fit(
    documents: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    most_rows: int = 20_000,
    most_features: int = 4_096,
    least_clear: float = 3.0,
    most_pairs: int = 20_000,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    swap_penalty: float = 1.0,
) -> Model:
    """Fit on at most ``most_rows`` labelled texts, those whose key has the smallest hash.

    Spark extracts the features and counts them by label; kept are those whose log odds differ by at
    least ``least_clear`` standard errors, the ``most_features`` clearest of them. Of all swaps of a sentence's terms by others of their group that change a feature, those
    with the smallest hash are kept, in turn for each group and distance, ``most_pairs`` in all. What
    reaches the driver is bounded by the three limits. A key with several
    labels counts as 1 if any is 1; null labels and keys are left out. Without labelled texts all
    weights are 0. Null texts count as empty.
    """
    chosen = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .where("key is not null and label is not null")
        .groupBy("key")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(most_rows)
    )
    # At most ``most_rows`` rows of a key and a label: small enough for every executor.
    sample = documents.select(F.col(key).alias("key"), utf8(text).alias("text")).join(
        F.broadcast(chosen), "key"
    )

    name = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, DIMENSIONS), np.int64)
        rows, features = np.zeros(2, np.int64), worker_state((name,), Features)
        for batch in slices(batches, "text"):
            for t, y in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                found = features.of(t.decode("utf-8", "replace"))
                seen[int(y > 0), list(found)] += 1
                rows[int(y > 0)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(at, -1)),
                pa.array(np.append(seen[1, at], rows[1])),
                pa.array(np.append(seen[0, at], rows[0])),
            ],
            ["feature", "ones", "zeros"],
        )

    counted = (
        sample.select("text", "label")
        .mapInArrow(count, "feature bigint, ones bigint, zeros bigint")
        .groupBy("feature")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    )
    total = counted.where("feature = -1").first()
    if total is None or not total["ones"] + total["zeros"]:
        return Model()
    odds = F.log((F.col("ones") + 0.5) / (total["ones"] - F.col("ones") + 0.5)) - F.log(
        (F.col("zeros") + 0.5) / (total["zeros"] - F.col("zeros") + 0.5)
    )
    error = F.sqrt(1 / (F.col("ones") + 0.5) + 1 / (F.col("zeros") + 0.5))
    kept = [
        r["feature"]
        for r in counted.where("feature >= 0")
        .select("feature", F.abs(odds / error).alias("clear"))
        .where(F.col("clear") >= least_clear)
        .orderBy(F.desc("clear"), "feature")
        .limit(most_features)
        .collect()
    ]
    columns = {f: i for i, f in enumerate(kept)}
    column_of = documents.sparkSession.sparkContext.broadcast(columns)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(column_of.value)
        for batch in slices(batches, "text"):
            found = [sorted(features.of(t.decode("utf-8", "replace"))) for t in batch["text"].to_pylist()]
            ones = [int(y > 0) for y in batch["label"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), pa.array(ones, pa.int32())],
                ["found", "label"],
            )

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(column_of.value)
        for batch in slices(batches, "text"):
            for k, t in zip(batch["key"], batch["text"].to_pylist()):
                out = []
                for place, group, step, before, after in counterfactuals(
                    t.decode("utf-8", "replace"), groups
                ):
                    a, b = features.of_words(before), features.of_words(after)
                    if a != b:
                        out.append((k.as_py(), place, group, step, sorted(a - b), sorted(b - a)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, f.type) for v, f in zip(zip(*out), swap_schema)],
                        schema=swap_schema,
                    )

    rows = sample.select("text", "label").mapInArrow(extract, "found array<int>, label int").collect()
    rows.sort(key=lambda r: (r["label"], r["found"]))  # the order of tasks must not matter
    kind = sample.schema["key"].dataType
    rest = StructType.fromDDL("place int, `group` int, step int, before array<int>, after array<int>")
    swap_type = StructType([StructField("key", kind), *rest])
    swap_schema = to_arrow_schema(swap_type)
    swaps = sample.select("key", "text").mapInArrow(swap, swap_type)
    order = [F.xxhash64("key", "place", "group", "step"), "before", "after"]
    turn = F.row_number().over(Window.partitionBy("group", "step").orderBy(*order))
    chosen_swaps = (
        swaps.withColumn("turn", turn)
        .where(F.col("turn") <= most_pairs)
        .orderBy("turn", "group", "step")
        .limit(most_pairs)
        .select("before", "after")
        .collect()
    )
    pairs = [(r["before"], r["after"]) for r in chosen_swaps]
    weights, intercept = train(
        [r["found"] for r in rows],
        np.array([r["label"] for r in rows], float),
        pairs,
        len(kept),
        swap_penalty,
    )
    return Model({f: float(w) for f, w in zip(kept, weights) if w}, intercept)


def with_scores(
    documents: DataFrame, model: Model, text: str = "text", out: str = "toxicity"
) -> DataFrame:
    """All columns of ``documents`` and ``out``, the probability of the label (0 to 1).

    Reads whole texts on the map side. Null and empty texts get the score of no features. A column
    already called ``out`` is replaced. Rows are neither dropped nor merged.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    names = [c for c in documents.columns if c != out]
    spare = f"__{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sent.value.weights
        weight_of = list(kept.values()).__getitem__
        features = worker_state((spare,), lambda: Features({f: i for i, f in enumerate(kept)}))
        for batch in slices(batches, spare):
            total = [
                sum(map(weight_of, sorted(features.of(t.decode("utf-8", "replace")))))
                for t in batch.column(spare).to_pylist()
            ]
            z = np.clip(np.array(total, float) + sent.value.intercept, -700, 700)
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(1 / (1 + np.exp(-z)))], [*names, out]
            )

    source = documents.select(*(F.col(f"`{c}`") for c in names), utf8(text).alias(spare))
    schema = documents.select(*(F.col(f"`{c}`") for c in names)).schema.add(out, "double")
    return source.mapInArrow(run, schema)


def remainder(key: str, divisor: int):
    """crc32 of the key as text, modulo ``divisor``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    scored = with_scores(documents, fit(documents, labels), out="score")
    return scored.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
