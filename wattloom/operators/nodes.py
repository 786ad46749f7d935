"""First-seen times, learning status and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import DAY_MS
from .sequences import WINDOW

# Fixed values.
LEARNING_DAYS = 30
MIN_READINGS = 100


def first_seen(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("node_id").agg(F.min("timestamp").alias("first_seen_ms"))


def merge_first_seen(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Known first-seen times lowered by a batch of readings. Retention never touches
    this table, so a node that left learning mode never falls back."""
    return (
        known.select("node_id", "first_seen_ms")
        .unionByName(first_seen(batch))
        .groupBy("node_id")
        .agg(F.min("first_seen_ms").alias("first_seen_ms"))
    )


def _graduated(as_of_ms: int, days: int) -> Column:
    return F.lit(as_of_ms) - F.col("first_seen_ms") >= days * DAY_MS


def node_status(seen: DataFrame, as_of_ms: int, days: int = LEARNING_DAYS) -> DataFrame:
    """Learning mode, days since first seen and days left, as of a given time."""
    since = (F.lit(as_of_ms) - F.col("first_seen_ms")) / F.lit(float(DAY_MS))
    learning = F.coalesce(since < days, F.lit(True))
    left = F.when(learning, F.greatest(F.lit(0.0), days - since)).otherwise(0.0)
    unknown = F.col("first_seen_ms").isNull()
    return seen.select(
        "node_id",
        learning.alias("learning_mode"),
        "first_seen_ms",
        F.bround(since, 1).alias("days_since_first_seen"),
        F.when(unknown, float(days)).otherwise(F.bround(left, 1)).alias("days_remaining"),
    )


def status_of_node(telemetry: DataFrame, node_id: str, as_of_ms: int) -> DataFrame:
    """Status of one node; no row when the node is unknown."""
    return node_status(first_seen(telemetry.where(F.col("node_id") == node_id)), as_of_ms)


def past_learning(
    readings: DataFrame, seen: DataFrame, as_of_ms: int, days: int = LEARNING_DAYS
) -> DataFrame:
    """Readings of nodes first seen at least ``days`` ago.

    The graduated nodes are filtered first. The semi join is broadcast or split by
    AQE from measured sizes, so a hot node does not land in one task.
    """
    graduated = seen.where(_graduated(as_of_ms, days)).select("node_id")
    return readings.join(graduated, "node_id", "left_semi")


def detector_readiness(
    telemetry: DataFrame, days: int = LEARNING_DAYS, min_rows: int = MIN_READINGS
) -> DataFrame:
    """Span and size of the stored readings, and whether a detector may be trained."""
    span = (F.max("timestamp") - F.min("timestamp")) / F.lit(float(DAY_MS))
    count = F.count(F.lit(1))
    return telemetry.agg(
        F.min("timestamp").alias("min_ms"),
        F.max("timestamp").alias("max_ms"),
        count.alias("readings"),
        span.alias("span_days"),
        F.coalesce((span >= days) & (count >= min_rows), F.lit(False)).alias("ready"),
    )


def forecaster_readiness(features: DataFrame, days: int = LEARNING_DAYS) -> DataFrame:
    """As above for the forecaster: span, and some node with at least 34 hourly rows."""
    per_node = (
        features.where(F.col("avg_power").isNotNull())
        .groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    )
    span = (F.max("b") - F.min("a")) / F.lit(float(DAY_MS))
    return per_node.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        span.alias("span_days"),
        F.count_if(F.col("n") >= WINDOW).alias("long_nodes"),
        F.coalesce((span >= days) & (F.count_if(F.col("n") >= WINDOW) > 0), F.lit(False)).alias(
            "ready"
        ),
    )
