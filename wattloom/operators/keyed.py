"""Operators on keyed tables: first write wins, insert if absent, key checks, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import hour_ms


def first_wins(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the lowest ``order`` value.

    ``min_by`` per column keeps a fixed-size buffer and combines inside each task, so
    a key repeated in a third of all rows costs one row per task in the shuffle. The order
    value must be unique, such as a message's topic, partition and offset: then all columns
    come from the same row.
    """
    others = [c for c in frame.columns if c not in (*keys, order)]
    picked = [F.min_by(c, order).alias(c) for c in others]
    return frame.groupBy(*keys).agg(*picked, F.min(order).alias(order)).select(*frame.columns)


def insert_if_absent(
    incoming: DataFrame, stored: DataFrame, keys: list[str], order: str
) -> DataFrame:
    """Rows of ``incoming`` that would be inserted: first per key, key not yet stored."""
    return first_wins(incoming, keys, order).join(stored.select(*keys), keys, "left_anti")


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return (
        frame.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def node_integrity(telemetry: DataFrame) -> DataFrame:
    """Rows and distinct timestamps per node; they agree when nothing is stored twice."""
    return telemetry.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("timestamp").alias("distinct_timestamps"),
    )


def entity_count(frame: DataFrame, column: str = "node_id") -> DataFrame:
    return frame.agg(F.countDistinct(column).alias("entities"))


def sequence_gaps(health: DataFrame) -> DataFrame:
    """Jumps of more than one in a node's ``sequence_no``.

    A window per node over raw messages would put a hot node into one task. Messages
    are compared within node and hour. Only the first and last message of each hour,
    at most two rows per node and hour, go on to a window per node that compares the
    first of an hour with the last of the node's hour before.
    """
    rows = health.select("node_id", "timestamp", "sequence_no", hour_ms("timestamp").alias("hour"))
    order = ["timestamp", "sequence_no"]
    within = Window.partitionBy("node_id", "hour").orderBy(*order)
    seen = rows.withColumns(
        {
            "previous": F.lag("sequence_no").over(within),
            "is_first": F.row_number().over(within) == 1,
            "is_last": F.lead("timestamp").over(within).isNull(),
        }
    )
    across = Window.partitionBy("node_id").orderBy(*order)
    edges = seen.where(F.col("is_first") | F.col("is_last"))
    firsts = edges.withColumn("previous", F.lag("sequence_no").over(across)).where("is_first")
    missing = F.col("sequence_no") - F.col("previous") - 1
    return (
        seen.where(~F.col("is_first"))
        .unionByName(firsts)
        .where(missing > 0)
        .select("node_id", "timestamp", "previous", "sequence_no", missing.alias("missing"))
    )


def field_pivot(points: DataFrame, fields: list[str]) -> DataFrame:
    """Tall points ``(node_id, timestamp, field, value)`` to one row per node and time.

    The fields are known, so one aggregate does it; a pivot would shuffle twice.
    """
    values = [
        F.first(F.when(F.col("field") == f, F.col("value")), ignorenulls=True).alias(f)
        for f in fields
    ]
    return points.groupBy("node_id", "timestamp").agg(*values)


def to_points(telemetry: DataFrame, fields: list[str]) -> DataFrame:
    """Wide readings to tall points."""
    return telemetry.unpivot(["node_id", "timestamp"], fields, "field", "value")
