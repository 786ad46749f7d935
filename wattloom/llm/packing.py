"""Best-fit packing of token sequences by non-negative least squares over length patterns."""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, slices, stored, table, utf8, worker_state
from .pretokens import Cache, runs

TOKENIZER = "word_bpe_49k.json"


def pieces(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    tokenizer: str = TOKENIZER,
    capacity: int = 4096,
    end_id: int = 1,
) -> DataFrame:
    """Token pieces of every whole text: key, piece, start, length, ids_crc32.

    A text's ids end with ``end_id``; only a text of more than ``capacity`` ids is cut. A null or
    empty text is the end id alone. Equal rows give equal pieces, one set each.
    """
    end, name = np.array([end_id], "<u4").tobytes(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state((name, tokenizer), lambda: Cache(tokenizer, bytes))
        for batch in slices(batches, "text"):
            keys, split = batch.column("key").to_pylist(), []
            for t in batch.column("text").to_pylist():
                split.append(runs(t))
            ids_of = cache.of(split)
            out: list[tuple] = []
            for k, words in zip(keys, split):
                ids = b"".join(map(ids_of, words)) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    out.append((k, n, at // 4, len(cut) // 4, zlib.crc32(cut)))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], batch.schema.field("key").type),
                    pa.array(columns[1], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in columns[2:]),
                ],
                ["key", "piece", "start", "length", "ids_crc32"],
            )

    source = documents.select(F.col(key).alias("key"), utf8(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(
        run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    ).withColumnRenamed("key", key)


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Minimise |ax - b| with x >= 0 by an active set of columns."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = 0
        best = int(gain.argmax())
        if gain[best] <= 1e-7 * max(1.0, float(np.abs(b).max())):
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            trial = np.zeros_like(x)
            trial[at] = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            low = at[trial[at] <= 0]
            if not len(low):
                x = trial
                break
            step = min(1.0, float((x[low] / np.maximum(x[low] - trial[low], 1e-300)).min()))
            x = x + step * (trial - x)
            x[x < 1e-12] = 0
            free &= x > 0
            if not free.any():
                break
    return x


class Plan:
    """Runs of equal sequences. A run puts the pieces of one length with ranks ``first`` to
    ``first + n - 1`` at ``offset`` of the sequences ``base`` to ``base + n - 1``."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.taken = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int]] = []  # length, first, base, offset
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (base, n)
        self.slacks: list[int] = []

    def place(self, length: int, n: int, base: int, offset: int) -> None:
        self.runs.append((length, int(self.taken[length]), base, offset))
        self.taken[length] += n
        self.left[length] -= n

    def keep_open(self, free: int, base: int, n: int) -> None:
        if free and n:
            if free not in self.open:
                insort(self.slacks, free)
            self.open.setdefault(free, []).append((base, n))

    def new(self, lengths: list[int], n: int) -> None:
        offset = 0
        for length in lengths:
            self.place(length, n, self.sequences, offset)
            offset += length
        self.keep_open(self.capacity - offset, self.sequences, n)
        self.sequences += n

    def largest(self, low: int, high: int) -> int:
        """The longest length with pieces left in low..high, or 0."""
        at = np.flatnonzero(self.left[low : high + 1])
        return low + int(at[-1]) if len(at) else 0

    def pattern(self, classes: tuple[int, ...], width: int, n: int) -> None:
        """Up to ``n`` sequences with one piece of each class; the last fits best."""
        while n > 0:
            lengths: list[int] = []
            for c in classes[:-1]:
                length = self.largest((c - 1) * width + 1, min(c * width, self.capacity))
                if not length:
                    return
                lengths.append(length)
            free = self.capacity - sum(lengths)
            length = self.largest(max(1, (classes[-1] - 1) * width + 1), free)
            if not length:
                return
            lengths.append(length)
            uses = {x: lengths.count(x) for x in lengths}
            run = min(n, *(int(self.left[x]) // k for x, k in uses.items()))
            if not run:
                return
            self.new(lengths, run)
            n -= run

    def residue(self) -> None:
        """Best-fit decreasing over what is left, first into room left by patterns."""
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                at = bisect_left(self.slacks, length)
                if at < len(self.slacks):
                    free = self.slacks[at]
                    base, n = self.open[free].pop()
                    if not self.open[free]:
                        del self.open[free], self.slacks[at]
                    run = min(n, int(self.left[length]))
                    self.keep_open(free, base + run, n - run)
                    self.place(length, run, base, self.capacity - free)
                    self.keep_open(free - length, base, run)
                else:
                    each = self.capacity // length
                    full, rest = divmod(int(self.left[length]), each)
                    if full:
                        self.new([length] * each, full)
                    if rest:
                        self.new([length] * rest, 1)


def plan_packing(
    counts: np.ndarray, capacity: int = 4096, classes: int = 64, few: int = 4
) -> Plan:
    """Where the pieces of each length go, from the number of pieces by length alone.

    Lengths are grouped into ``classes``; all patterns of at most ``few`` pieces whose classes fill
    a sequence are enumerated, repeat counts are fitted to the class histogram by non-negative
    least squares and rounded down, and what is left is packed best-fit decreasing, first into the
    room the patterns left. The work depends on the capacity, not on the number of pieces.
    """
    plan = Plan(counts, capacity)
    if counts[capacity]:
        plan.new([capacity], int(counts[capacity]))
    width = -(-capacity // classes)
    top = -(-capacity // width)
    of = -(-np.arange(capacity + 1) // width)
    histogram = np.bincount(of, weights=plan.left, minlength=top + 1)[1:].astype(float)
    here = [c for c in range(1, top + 1) if histogram[c - 1]]
    patterns = [
        tuple(sorted((*p, top - sum(p)), reverse=True))
        for k in range(1, few)
        for p in combinations_with_replacement(here, k)
        if 0 < top - sum(p) <= p[0] and histogram[top - sum(p) - 1]
    ]
    patterns = sorted(set(patterns))
    if patterns:
        matrix = np.zeros((top, len(patterns)))
        for j, p in enumerate(patterns):
            for c in p:
                matrix[c - 1, j] += 1
        repeats = np.floor(non_negative_least_squares(matrix, histogram) + 1e-9).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j]:
                plan.pattern(patterns[j], width, int(repeats[j]))
    plan.residue()
    return plan


def ranked(cut: DataFrame, key: str, counts: np.ndarray, most: int = 1000) -> DataFrame:
    """Adds ``rank``, from 0 among the pieces of a length. A frequent length is dealt over slots of
    about ``most`` pieces, numbered on their own and shifted by the sizes of the slots before, so
    none meets in a task."""
    at = np.flatnonzero(counts)
    slots = cut.sparkSession.createDataFrame(
        [(int(i), int(-(-counts[i] // most))) for i in at], "length bigint, slots bigint"
    )  # at most a row per length
    slotted = cut.join(F.broadcast(slots), "length").withColumn(
        "slot", F.pmod(F.xxhash64(key, "piece"), F.col("slots"))
    )
    within = Window.partitionBy("length", "slot").orderBy(key, "piece")
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = slotted.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n"))
    shifts = sizes.select(
        "length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    numbered = slotted.withColumn("row", F.row_number().over(within).cast("bigint") - 1)
    joined = numbered.join(shifts, ["length", "slot"])
    ranks = joined.withColumn("rank", F.col("row") + F.col("shift"))
    return ranks.drop("slot", "slots", "row", "shift")


def pack(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    tokenizer: str = TOKENIZER,
    capacity: int = 4096,
    end_id: int = 1,
    classes: int = 64,
    few: int = 4,
) -> DataFrame:
    """Pack all texts into sequences of at most ``capacity`` tokens.

    One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset. The texts are
    read and tokenised once; the driver sees only the number of pieces per length. Null and empty
    texts are one end id. Repeated rows are packed once each, in any order among themselves. A null
    key stays null. An empty table gives no rows. Columns other than key and text are not read.
    """
    cut = stored(pieces(documents, text, key, tokenizer, capacity, end_id))
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    plan = plan_packing(counts, capacity, classes, few)
    placed = np.array(plan.runs, np.int64).reshape(-1, 4)
    order = np.lexsort((placed[:, 1], placed[:, 0]))
    placed = placed[order]
    # One sortable number per run: length above the rank.
    heads = cut.sparkSession.sparkContext.broadcast(((placed[:, 0] << 48) + placed[:, 1], placed))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, known = heads.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = known[np.searchsorted(starts, (length << 48) + rank, "right") - 1]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array(run[:, 2] + rank - run[:, 1], pa.int64()),
                    pa.array(run[:, 3], pa.int64()),
                ],
                [*names, "sequence_id", "offset"],
            )

    rows = ranked(cut, key, counts).select(
        key, "piece", "start", "length", "ids_crc32", "rank"
    )
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(
        assign,
        f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint",
    )


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
