"""Feature scaling. A fitted scaler is a one-row frame used as a scalar subquery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_active
from ..functions.timecols import utc_hour, weekday_monday0

FEATURES = ["hour_of_day", "day_of_week", "is_active"]


def detector_features(readings: DataFrame) -> DataFrame:
    """Add hour (UTC), weekday (0 = Monday) and activity flag."""
    return readings.withColumns(
        {
            "hour_of_day": utc_hour("timestamp"),
            "day_of_week": weekday_monday0("timestamp"),
            "is_active": is_active("power"),
        }
    )


def fit_standard(
    frame: DataFrame, columns: list[str] = FEATURES, weight: str | None = None
) -> DataFrame:
    """Mean and population deviation per column; a constant column scales by 1.

    With ``weight`` each row counts that many times (pre-aggregated input).
    """
    parts = []
    for c in columns:
        if weight is None:
            mean, deviation = F.avg(c), F.stddev_pop(c)
        else:
            n = F.sum(weight)
            mean = F.sum(F.col(c) * F.col(weight)) / n
            square = F.sum(F.col(c) * F.col(c) * F.col(weight)) / n
            deviation = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
        parts.append(mean.alias(f"mean_{c}"))
        parts.append(F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"scale_{c}"))
    return frame.agg(*parts)


def apply_standard(frame: DataFrame, scaler: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    s = scaler.select(F.struct(*scaler.columns)).scalar()
    return frame.withColumns(
        {f"{c}_scaled": (F.col(c) - s[f"mean_{c}"]) / s[f"scale_{c}"] for c in columns}
    )


def fit_min_max(windows: DataFrame) -> DataFrame:
    """Range of all values inside emitted windows (a stride can skip a tail value)."""
    low = F.least(F.array_min("x"), F.array_min("y"))
    high = F.greatest(F.array_max("x"), F.array_max("y"))
    return windows.agg(F.min(low).alias("low"), F.max(high).alias("high"))


def with_range(frame: DataFrame, scaler: DataFrame) -> DataFrame:
    """Attach the fitted range as a struct column; a constant series scales by 1."""
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    return frame.withColumn("_fit", scaler.select(F.struct("low", span.alias("span"))).scalar())


def apply_min_max(frame: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    low, span = F.col("_fit.low"), F.col("_fit.span")
    scaled = {c: F.transform(c, lambda v: (v - low) / span) for c in columns}
    return with_range(frame, scaler).withColumns(scaled).drop("_fit")


def invert_min_max(frame: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Back to watts, no negatives."""
    low, span = F.col("_fit.low"), F.col("_fit.span")
    watts = {
        c: F.transform(c, lambda v: F.greatest(F.lit(0.0), v * span + low)) for c in columns
    }
    return with_range(frame, scaler).withColumns(watts).drop("_fit")
