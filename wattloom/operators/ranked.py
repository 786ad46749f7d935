"""Exact order statistics and ranked picks that never sort a whole table in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import HOUR_MS

MAX_LIMIT = 1000
SLOTS = 10_000


def newest(frame: DataFrame, time: str, limit: int, ties: list[str]) -> DataFrame:
    """Top ``limit`` rows by descending time (partial top-k per task)."""
    return frame.orderBy(F.desc(time), *ties).limit(check_limit(limit))


def oldest(frame: DataFrame, time: str, limit: int, ties: list[str]) -> DataFrame:
    return frame.orderBy(F.asc(time), *ties).limit(check_limit(limit))


def check_limit(limit: int, low: int = 1, high: int = MAX_LIMIT) -> int:
    if not low <= limit <= high:
        raise ValueError(f"limit must be between {low} and {high}")
    return limit


def oldest_rows(frame: DataFrame, n: int, time: str = "timestamp", tie: str = "node_id") -> DataFrame:
    """The ``n`` oldest rows, for limits too large for a plain top-k.

    A top-k sends ``n`` rows per task to one task. Counts per hour, then per second of the hour that
    completes ``n`` rows, then per millisecond of that second give the exact cutoff time, so only
    about ``n`` rows are left to order. Each count has a row per hour of history, 3,600 or 1,000 rows.
    """
    up_to = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    part, before, cutoff = frame, F.lit(0), None
    for step in (HOUR_MS, 1000, 1):
        start = F.col(time) - F.pmod(F.col(time), F.lit(step))
        if cutoff is not None:
            part = part.where(F.col(time).between(cutoff, cutoff + (wider - 1)))
        counts = part.groupBy(start.alias("t")).agg(F.count(F.lit(1)).alias("c"))
        reached = counts.withColumn("cum", F.sum("c").over(up_to) + before)
        first = F.min(F.struct("t", (F.col("cum") - F.col("c")).alias("before")))
        last = reached.where(F.col("cum") >= n).agg(first).scalar()
        cutoff, before, wider = last["t"], last["before"], step
    kept = frame.where(F.col(time) <= F.coalesce(cutoff, F.col(time)))
    return kept.orderBy(time, tie).limit(n)


def exact_quantile(frame: DataFrame, column: str, q: float, accuracy: int = 50_000) -> DataFrame:
    """One row ``quantile``: the linearly interpolated ``q`` quantile, exact; NULL without values.

    The built-in exact percentile gathers every distinct value in one task. Here a fixed-size
    sketch brackets the wanted rank to within ``4 / accuracy`` of the rows, which exceeds the
    sketch's own error. Then rows are counted in equal slots of the bracket, and the slots around
    the rank become the next bracket, until few values are left. Each step is one aggregate with
    at most ``SLOTS`` rows. A rank outside the bracket raises instead of returning a wrong value.
    """
    spark = frame.sparkSession
    values = frame.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    ends = [max(0.0, q - 4.0 / accuracy), min(1.0, q + 4.0 / accuracy)]
    n, sketch = values.agg(F.count("v"), F.percentile_approx("v", ends, accuracy)).first()
    if not n:
        return spark.createDataFrame([(None,)], "quantile DOUBLE")
    low, high = sketch
    # The sketch's rank rounds up and the wanted one is interpolated: one more value either side.
    v = F.col("v")
    before, below, above = values.agg(
        F.count_if(v < low), F.max(F.when(v < low, v)), F.min(F.when(v > high, v))
    ).first()
    if below is not None:
        before -= values.where(v == below).count()
        low = below
    high = high if above is None else above
    position = (n - 1) * q
    first, last = math.floor(position), math.ceil(position)
    while True:
        slot = _slot(low, high)
        inside = values.where(v.between(low, high))
        counts = inside.groupBy(slot.alias("slot")).agg(
            F.count(v).alias("c"), F.min(v).alias("low"), F.max(v).alias("high")
        )
        slots = counts.orderBy("slot").collect()
        hit, cum = [], before
        for s in slots:
            if cum + s["c"] > first and cum <= last:
                hit.append((cum, s))
            cum += s["c"]
        if not hit or hit[0][0] > first or cum <= last:
            raise ValueError("the quantile's rank fell outside its bracket")
        before, low, high = hit[0][0], hit[0][1]["low"], hit[-1][1]["high"]
        if all(s["low"] == s["high"] for _, s in hit):
            break  # each slot that matters holds a single value
    at = lambda rank: next(s["low"] for c, s in hit if c <= rank < c + s["c"])
    value = at(first) + (at(last) - at(first)) * (position - first)
    return spark.createDataFrame([(float(value),)], "quantile DOUBLE")


def _slot(low: float, high: float) -> Column:
    """Slot of ``v`` between two values, of equal width in the logarithm where the values span
    orders of magnitude: a heavy tail then does not leave everything in one slot. Values next to
    each other are told apart by whether they are the ends."""
    v = F.col("v")
    wide = abs(high - low) > 1000 * max(1.0, min(abs(low), abs(high)))
    scaled = (lambda x: F.signum(x) * F.log1p(F.abs(x))) if wide else (lambda x: x)
    start, end = scaled(F.lit(low)), scaled(F.lit(high))
    within = F.floor((scaled(v) - start) / (end - start) * (SLOTS - 2)) + 1
    return F.when(v == low, 0).when(v == high, SLOTS).otherwise(within).cast("int")


def reproducible_sample(frame: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows with the lowest keyed hash; the same rows on any partitioning.

    A histogram over the hash's upper 16 bits gives the bucket that completes ``n``
    rows. Only rows up to that bucket, about ``n``, reach the final top-k.
    """
    name = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    digits = F.substring(F.md5(name.cast("binary")), 1, 15)
    hashed = frame.withColumn("_h", F.conv(digits, 16, 10).cast("bigint"))
    bucket = F.shiftright("_h", 44)
    counts = hashed.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    up_to = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("cum", F.sum("c").over(up_to))
    cutoff = reached.agg(
        F.coalesce(F.min(F.when(F.col("cum") >= n, F.col("b"))), F.max("b"))
    ).scalar()
    return hashed.where(bucket <= cutoff).orderBy("_h", *keys).limit(n).drop("_h")


def best_per_group(frame: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """The row with the lowest score per group; equal scores go to the lowest ``tie``."""
    others = [c for c in frame.columns if c not in (group, score, tie)]
    least = F.min(F.struct(score, tie, *others)).alias("r")
    return frame.groupBy(group).agg(least).select(group, "r.*").select(*frame.columns)
