"""Retention: what is kept, what expires, and how much."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import DAY_MS

# Fixed values.
RETENTION_DAYS = 30
BY_EVENT_TIME = [
    "telemetry_readings", "node_events", "node_health", "anomaly_records", "forecasts",
]
BY_CREATION = ["energy_features", "energy_analytics_hourly", "energy_analytics_daily"]


def cutoff_ms(as_of_ms: int, days: int = RETENTION_DAYS) -> int:
    return as_of_ms - days * DAY_MS


def expired(table: str, as_of_ms: int, days: int = RETENTION_DAYS) -> Column:
    """True for rows past retention; epoch-ms tables by event time, others by creation."""
    limit = cutoff_ms(as_of_ms, days)
    if table in BY_EVENT_TIME:
        return F.col("timestamp") < limit
    if table in BY_CREATION:
        return F.col("created_at") < F.timestamp_millis(F.lit(limit))
    raise ValueError(f"no retention rule for {table}")


def kept(frame: DataFrame, table: str, as_of_ms: int, days: int = RETENTION_DAYS) -> DataFrame:
    return frame.where(~F.coalesce(expired(table, as_of_ms, days), F.lit(False)))


def retention_counts(
    tables: dict[str, DataFrame], as_of_ms: int, days: int = RETENTION_DAYS
) -> DataFrame:
    """Kept and deleted rows per table."""
    parts = [
        frame.agg(
            F.lit(name).alias("table_name"),
            F.count_if(expired(name, as_of_ms, days)).alias("deleted"),
            F.count(F.lit(1)).alias("total"),
        )
        for name, frame in tables.items()
    ]
    counts = reduce(DataFrame.unionByName, parts)
    return counts.select("table_name", (F.col("total") - F.col("deleted")).alias("kept"), "deleted")


def total_deleted(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("deleted").alias("total_deleted"))
