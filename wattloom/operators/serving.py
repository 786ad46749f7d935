"""Filtered newest-first and oldest-first reads of the stored tables.

An empty or missing filter is no filter; a time bound of 0 is a bound. Ties on the
sort column, unspecified by the API, are broken by the remaining key columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import DAY_MS
from ..schemas import MEASURES, READING_FIELDS
from .ranked import newest, oldest

DEFAULT_LIMIT = 100
HISTORY_DAYS = 30
NODE_ID = re.compile(r"^[\w\-]+$")  # fixed value


def check_node_id(node_id: str | None) -> None:
    if node_id and not NODE_ID.match(node_id):
        raise ValueError("node_id may hold letters, digits, _ and - only")


def equals(frame: DataFrame, **filters: str | None) -> DataFrame:
    for column, wanted in filters.items():
        if wanted:
            frame = frame.where(F.col(column) == wanted)
    return frame


def hour_range(frame: DataFrame, start_ms: int | None, end_ms: int | None) -> DataFrame:
    """Inclusive range on ``hour_start``."""
    if start_ms is not None:
        frame = frame.where(F.col("hour_start") >= F.timestamp_millis(F.lit(start_ms)))
    if end_ms is not None:
        frame = frame.where(F.col("hour_start") <= F.timestamp_millis(F.lit(end_ms)))
    return frame


def date_range(frame: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Inclusive range on ``date`` (texts ``yyyy-MM-dd``)."""
    if start:
        frame = frame.where(F.col("date") >= F.to_date(F.lit(start)))
    if end:
        frame = frame.where(F.col("date") <= F.to_date(F.lit(end)))
    return frame


ROLLUP = ["total_consumption_wh", "avg_power_w", "peak_power_w", "reading_count"]


def hourly_analytics(
    hourly: DataFrame, node_id: str | None = None, division: str | None = None,
    start_ms: int | None = None, end_ms: int | None = None, limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    rows = hour_range(equals(hourly, node_id=node_id, division=division), start_ms, end_ms)
    return newest(
        rows.select("node_id", "division", "hour_start", *ROLLUP), "hour_start", limit, ["node_id"]
    )


def daily_analytics(
    daily: DataFrame, node_id: str | None = None, division: str | None = None,
    start: str | None = None, end: str | None = None, limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    rows = date_range(equals(daily, node_id=node_id, division=division), start, end)
    return newest(rows.select("node_id", "division", "date", *ROLLUP), "date", limit, ["node_id"])


def anomaly_records(
    anomalies: DataFrame, node_id: str | None = None, severity: str | None = None,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    rows = equals(anomalies, node_id=node_id, severity=severity).select(
        "node_id", "timestamp", "anomaly_type", "score", "severity"
    )
    return newest(rows, "timestamp", limit, ["node_id", "score"])


def latest_forecasts(forecasts: DataFrame) -> DataFrame:
    """The latest run's value per node and time. Rows without ``run_ts`` are of a single run."""
    if "run_ts" not in forecasts.columns:
        return forecasts
    return forecasts.groupBy("node_id", "timestamp").agg(
        F.max_by("predicted_consumption", "run_ts").alias("predicted_consumption")
    )


def forecast_records(
    forecasts: DataFrame, node_id: str | None = None, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Oldest first; of overlapping runs the latest counts."""
    rows = latest_forecasts(equals(forecasts, node_id=node_id)).select(
        "node_id", "timestamp", "predicted_consumption"
    )
    return oldest(rows, "timestamp", limit, ["node_id"])


def telemetry_history(
    telemetry: DataFrame, as_of_ms: int, node_id: str | None = None,
    start_ms: int | None = None, end_ms: int | None = None, limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Raw readings in ``[start, end)``, by default the last 30 days; missing values are 0.

    The bounds have second precision. A frame partitioned by ``event_date`` is pruned.
    """
    check_node_id(node_id)
    start = start_ms if start_ms is not None else as_of_ms - HISTORY_DAYS * DAY_MS
    end = end_ms if end_ms is not None else as_of_ms
    start, end = start // 1000 * 1000, end // 1000 * 1000
    rows = between_ms(equals(telemetry, node_id=node_id), start, end)
    filled = rows.select(
        "node_id", "timestamp", *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in MEASURES]
    )
    return newest(filled.select(*READING_FIELDS), "timestamp", limit, ["node_id"])


def between_ms(frame: DataFrame, start_ms: int, end_ms: int | None) -> DataFrame:
    """Half-open time range, without end if that is None, also on the partition column when there
    is one."""
    day = lambda ms: F.date_from_unix_date(F.lit(ms // DAY_MS).cast("int"))
    dated = "event_date" in frame.columns
    rows = frame.where(F.col("timestamp") >= start_ms)
    rows = rows.where(F.col("event_date") >= day(start_ms)) if dated else rows
    if end_ms is not None:
        rows = rows.where(F.col("timestamp") < end_ms)
        rows = rows.where(F.col("event_date") <= day(end_ms)) if dated else rows
    return rows


def before_ms(frame: DataFrame, end_ms: int) -> DataFrame:
    """Rows earlier than a time, also by the partition column when there is one."""
    rows = frame.where(F.col("timestamp") < end_ms)
    if "event_date" in frame.columns:
        last = F.date_from_unix_date(F.lit(end_ms // DAY_MS).cast("int"))
        rows = rows.where(F.col("event_date") <= last)
    return rows
