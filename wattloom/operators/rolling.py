"""Time-range windows at a cost that does not depend on their length.

A window over the last d days of every row holds up to 24 d rows, and a sliding frame works through
all of them for each row. Here a table of doubled steps holds, for every row, the aggregate of the
next 1, 2, 4, ... rows; any window is a few of its entries, and minima and maxima are just two. Sums
are added in pairs and deviations merged from parts, so nothing cancels: a constant window has
deviation 0.

A key's rows are cut into chunks of days, each with the days before it that its windows reach into,
so the rows of one key spread over tasks and a task holds one chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import DAY_MS

#: Days of a chunk; those it borrows come on top.
CHUNK_DAYS = 90
CHUNK, OWN = "__chunk", "__own"


@dataclass(frozen=True)
class Rolling:
    """An aggregate (avg, min, max or stddev) of a column over the last ``days``, both ends included."""

    name: str
    kind: str
    column: str
    days: int


class Doubling:
    """Aggregates of 2**k rows from each row on, a level at a time; windows are [begin, end)."""

    def __init__(self, values: np.ndarray, known: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.values, self.known = values, known
        self.begin, self.length = begin, end - begin
        self.levels = int(self.length.max(initial=0)).bit_length()

    @staticmethod
    def _ahead(level: np.ndarray, step: int) -> np.ndarray:
        """The entries ``step`` rows on; windows never reach past the end."""
        out = np.zeros_like(level)
        out[: len(level) - step] = level[step:]
        return out

    def _walk(self, start, merge):
        """Merge the entries that make up each window, from short to long."""
        at = self.begin.copy()
        level, total = start, tuple(np.zeros_like(part) for part in start)
        for k in range(self.levels):
            chosen = np.flatnonzero((self.length >> k) & 1)
            here = tuple(part[at[chosen]] for part in level)
            both = merge(tuple(part[chosen] for part in total), here)
            for part, new in zip(total, both):
                part[chosen] = new
            at[chosen] += 1 << k
            if k + 1 < self.levels:
                level = merge(level, tuple(self._ahead(part, 1 << k) for part in level))
        return total

    def counts(self) -> np.ndarray:
        before = np.concatenate(([0], np.cumsum(self.known)))
        return before[self.begin + self.length] - before[self.begin]

    def avg(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums carry what rounding took from them, and a mean has 15 significant digits: it depends
        neither on the order of adding nor on the last bits of values that were rounded before."""

        def merge(a, b):
            total = a[0] + b[0]
            part = total - a[0]
            lost = (a[0] - (total - part)) + (b[0] - part)
            # Beyond the finite numbers there is nothing to carry.
            return total, np.where(np.isfinite(total), a[1] + b[1] + lost, 0.0)

        values = np.where(self.known, self.values, 0.0)
        with np.errstate(invalid="ignore", over="ignore"):
            total, lost = self._walk((values, np.zeros(len(values))), merge)
        n = self.counts()
        return _digits((total + lost) / np.maximum(n, 1)), n > 0

    def stddev(self) -> tuple[np.ndarray, np.ndarray]:
        """Of a sample; unknown for fewer than two values."""
        mean = np.where(self.known, self.values, 0.0)

        def merge(a, b):
            n = a[0] + b[0]
            gap = b[1] - a[1]
            share = b[0] / np.maximum(n, 1)
            mean = np.where(a[0] == 0, b[1], a[1] + gap * share)
            apart = np.where((a[0] == 0) | (b[0] == 0), 0.0, gap * gap * a[0] * share)
            return n, mean, a[2] + b[2] + apart

        n, _, squares = self._walk((self.known.astype(float), mean, np.zeros(len(mean))), merge)
        return np.sqrt(squares / np.maximum(n - 1, 1)), n > 1

    def _extreme(self, values: np.ndarray, better) -> np.ndarray:
        """Two overlapping entries cover a window."""
        out = np.empty(len(self.begin))
        highest = np.frexp(np.maximum(self.length, 1))[1] - 1  # floor of the logarithm
        level = values
        for k in range(max(1, self.levels)):
            chosen = np.flatnonzero(highest == k)
            last = self.begin[chosen] + np.maximum(self.length[chosen], 1) - (1 << k)
            out[chosen] = better(level[self.begin[chosen]], level[last])
            level = better(level, self._ahead(level, 1 << k))
        return out

    def min(self) -> tuple[np.ndarray, np.ndarray]:
        """NaN is above all numbers, so it is the least only where nothing else is known."""
        number = self.known & ~np.isnan(self.values)
        least = self._extreme(np.where(number, self.values, np.inf), np.minimum)
        numbers = Doubling(self.values, number, self.begin, self.begin + self.length).counts()
        return np.where(numbers > 0, least, np.nan), self.counts() > 0

    def max(self) -> tuple[np.ndarray, np.ndarray]:
        return self._extreme(np.where(self.known, self.values, -np.inf), np.maximum), self.counts() > 0


def _digits(values: np.ndarray, digits: int = 15) -> np.ndarray:
    """Rounded to significant digits, where these are within the range of powers of ten."""
    size = np.abs(values)
    plain = (size > 1e-200) & (size < 1e200)
    places = digits - 1 - np.floor(np.log10(np.where(plain, size, 1.0)))
    up, down = 10.0 ** np.maximum(places, 0), 10.0 ** np.maximum(-places, 0)
    return np.where(plain, np.rint(np.where(plain, values, 0.0) * up / down) / up * down, values)


def _group_starts(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns; nulls are equal."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _windows(times: np.ndarray, starts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows [begin, end) whose time is within ``reach`` before a row's own, in its group; rows of
    one time are in each other's windows."""
    group = np.cumsum(starts) - 1
    first = times[np.flatnonzero(starts)][group]
    # Times count from the start of the group, and groups lie farther apart than any window reaches.
    width = np.int64(int((times - first).max(initial=0)) + reach + 1)
    place = group * width + (times - first)
    least = np.maximum(place - reach, group * width)
    return np.searchsorted(place, least), np.searchsorted(place, place, "right")


def _rolled(table: pa.Table, wanted: list[Rolling], keys: list[str], time: str) -> pa.RecordBatch:
    """Whole groups in order, with the aggregates; borrowed rows are left out."""
    batch = table.combine_chunks().to_batches()[0]
    starts = _group_starts([batch.column(c) for c in (*keys, CHUNK)])
    times = pc.fill_null(batch.column(time), 0).to_numpy()
    own = batch.column(OWN)
    spans = {days: _windows(times, starts, days * DAY_MS) for days in {w.days for w in wanted}}
    added = []
    for w in wanted:
        column = batch.column(w.column)
        known = pc.is_valid(column).to_numpy(zero_copy_only=False)
        values = pc.fill_null(column, 0).cast(pa.float64()).to_numpy()
        result, defined = getattr(Doubling(values, known, *spans[w.days]), w.kind)()
        added.append(pa.array(result, mask=~defined))
    names = [n for n in batch.schema.names if n not in (CHUNK, OWN)]
    out = pa.RecordBatch.from_arrays(
        [*(batch.column(n) for n in names), *added], [*names, *(w.name for w in wanted)]
    )
    return out.filter(own)


def with_rolling(
    rows: DataFrame,
    wanted: list[Rolling],
    keys: list[str],
    time: str = "timestamp",
    chunk_days: int = CHUNK_DAYS,
) -> DataFrame:
    """Add aggregates over the last days of every row of its key; ``time`` is in milliseconds.

    Equal to range windows: both ends are included, as are rows of the same time; nulls are left out,
    and a window without values (or, for a deviation, with fewer than two) gives null. A null time is
    equal to other null times only. Rows keep their other columns.
    """
    reach = max(w.days for w in wanted)
    day = F.floor(F.col(time) / DAY_MS)
    first = F.floor(day / chunk_days)
    # A row also goes to the chunks whose windows reach back to it.
    last = F.floor((day + reach) / chunk_days)
    chunks = F.when(F.col(time).isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(
        F.sequence(first, last)
    )
    spread = rows.withColumns({CHUNK: F.explode(chunks), OWN: F.lit(True)}).withColumn(
        OWN, F.coalesce(F.col(CHUNK) == first, F.lit(True))
    )
    # The number of tasks is Spark's to choose; one chunk of one key is the largest indivisible part.
    sorted_rows = spread.repartition(*keys, CHUNK).sortWithinPartitions(*keys, CHUNK, time)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [table.column(c).combine_chunks() for c in (*keys, CHUNK)]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            cut = int(np.flatnonzero(_group_starts(columns))[-1])
            # The last group may go on in the next batch.
            if cut:
                yield _rolled(table.slice(0, cut), wanted, keys, time)
            held = table.slice(cut).to_batches()
        if held:
            yield _rolled(pa.Table.from_batches(held), wanted, keys, time)

    schema = T.StructType([*rows.schema.fields, *(T.StructField(w.name, T.DoubleType()) for w in wanted)])
    return sorted_rows.mapInArrow(run, schema)
