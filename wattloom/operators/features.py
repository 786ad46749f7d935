"""Hourly features per node: calendar fields, lags, rolling statistics.

Windows run over hourly rows. One node has at most one row per hour of history
(8,760 a year), so a window partition is bounded by time, not by the number of raw
readings, however hot the node. Lags are windows per node; rolling statistics work on
chunks of days and cost the same for any length, see :mod:`rolling`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import day_of_month, day_of_week_sunday1, hour_ms, utc_hour
from . import rolling
from .rolling import Rolling

# Row offsets of the lags, days of the rolling averages, lineage marks.
LAG_ROWS = {"lag_1h": 1, "lag_24h": 24, "lag_168h": 168}
ROLLING_DAYS = {"rolling_avg_1d": 1, "rolling_avg_7d": 7, "rolling_avg_30d": 30}
VERSION = "2.0"
LEVEL = "hourly"


def hourly_features(telemetry: DataFrame) -> DataFrame:
    """Raw readings to one row per node and hour; ``timestamp`` is the hour start in ms."""
    return telemetry.groupBy("node_id", hour_ms("timestamp").alias("timestamp")).agg(
        F.avg("power").alias("avg_power"),
        F.avg("voltage").alias("avg_voltage"),
        F.avg("current").alias("avg_current"),
        F.min("power").alias("min_power"),
        F.max("power").alias("max_power"),
        F.stddev("power").alias("std_power"),
        F.avg("energy_wh").alias("avg_energy_wh"),
        F.count("power").cast("int").alias("reading_count"),
    )


def with_calendar(hourly: DataFrame) -> DataFrame:
    """``hour`` 0-23, ``day_of_week`` 1 = Sunday, ``day_of_month``."""
    return hourly.withColumns(
        {
            "hour": utc_hour("timestamp"),
            "day_of_week": day_of_week_sunday1("timestamp"),
            "day_of_month": day_of_month("timestamp"),
        }
    )


def _by_node() -> Window:
    return Window.partitionBy("node_id").orderBy("timestamp")


def with_lags(hourly: DataFrame) -> DataFrame:
    """Lags count rows, so a gap in the hours shifts them."""
    return hourly.withColumns(
        {name: F.lag("avg_power", n).over(_by_node()) for name, n in LAG_ROWS.items()}
    )


ROLLING = [
    *(Rolling(name, "avg", "avg_power", days) for name, days in ROLLING_DAYS.items()),
    Rolling("rolling_min_24h", "min", "min_power", 1),
    Rolling("rolling_max_24h", "max", "max_power", 1),
    Rolling("rolling_std_24h", "stddev", "avg_power", 1),
]


def with_rolling(hourly: DataFrame) -> DataFrame:
    """Both ends of a range count, so a day can hold 25 hourly rows."""
    return rolling.with_rolling(hourly, ROLLING, ["node_id"])


def with_lineage(features: DataFrame) -> DataFrame:
    return features.withColumns(
        {
            "feature_timestamp": F.timestamp_millis("timestamp"),
            "created_at": F.current_timestamp(),
            "pipeline_version": F.lit(VERSION),
            "aggregation_level": F.lit(LEVEL),
        }
    )


def engineer_features(hourly: DataFrame) -> DataFrame:
    return with_lineage(with_rolling(with_lags(with_calendar(hourly))))


def feature_quality(features: DataFrame) -> DataFrame:
    """Null counts of the critical columns and negative power, in one pass."""
    nulls = [
        F.count_if(F.col(c).isNull()).alias(f"null_{c}")
        for c in ("timestamp", "avg_power", "hour", "day_of_week")
    ]
    return features.agg(
        F.count(F.lit(1)).alias("row_count"),
        *nulls,
        F.count_if(F.col("avg_power") < 0).alias("negative_power"),
    )
