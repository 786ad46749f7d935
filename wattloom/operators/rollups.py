"""Hourly and daily rollups.

Every rollup is a two-phase hash aggregate keyed by node and bucket, so a node that
sends a third of all readings is reduced inside each task before the shuffle. The
node's division is joined to the finished rollup (at most one row per node and hour),
never to the raw readings; ``node_id`` is the key of the metadata table, so this
equals joining first. The join carries no hint: AQE broadcasts the metadata only
when its measured size allows it and sort-merges otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import day_ms, hour_ms, utc_date


def hourly_partials(telemetry: DataFrame) -> DataFrame:
    """Mergeable sums per node and hour; hourly and daily rollups both derive from it."""
    return (
        telemetry.groupBy("node_id", hour_ms("timestamp").alias("hour_ms")).agg(
            F.sum("energy_wh").alias("energy_sum"),
            F.sum("power").alias("power_sum"),
            F.count("power").alias("power_count"),
            F.max("power").alias("peak_power_w"),
            F.count(F.lit(1)).alias("reading_count"),
        )
    )


def _measures() -> list:
    mean = F.when(F.col("power_count") > 0, F.col("power_sum") / F.col("power_count"))
    return [
        F.col("energy_sum").alias("total_consumption_wh"),
        mean.alias("avg_power_w"),
        F.col("peak_power_w"),
        F.col("reading_count"),
    ]


def with_division(rollup: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attach the node's division; NULL for unknown nodes."""
    divisions = metadata.select("node_id", F.col("location").alias("division"))
    return rollup.join(divisions, "node_id", "left")


def hourly_from_partials(partials: DataFrame, metadata: DataFrame) -> DataFrame:
    return with_division(partials, metadata).select(
        "node_id", "division", "hour_ms",
        F.timestamp_millis("hour_ms").alias("hour_start"),
        *_measures(),
    )


def daily_from_partials(partials: DataFrame, metadata: DataFrame) -> DataFrame:
    """Daily rollup from hourly sums and counts (an average of averages would be wrong)."""
    daily = partials.groupBy("node_id", day_ms("hour_ms").alias("day_ms")).agg(
        F.sum("energy_sum").alias("energy_sum"),
        F.sum("power_sum").alias("power_sum"),
        F.sum("power_count").alias("power_count"),
        F.max("peak_power_w").alias("peak_power_w"),
        F.sum("reading_count").alias("reading_count"),
    )
    return with_division(daily, metadata).select(
        "node_id", "division", utc_date("day_ms").alias("date"), *_measures()
    )


def hourly_rollup(telemetry: DataFrame, metadata: DataFrame) -> DataFrame:
    return hourly_from_partials(hourly_partials(telemetry), metadata)


def daily_rollup(telemetry: DataFrame, metadata: DataFrame) -> DataFrame:
    return daily_from_partials(hourly_partials(telemetry), metadata)


def join_metadata(telemetry: DataFrame, metadata: DataFrame) -> DataFrame:
    """Reading-level join with metadata, for callers that need raw rows.

    AQE splits skewed partitions of the reading side of a left join.
    """
    return with_division(telemetry, metadata)


def hourly_mean(readings: DataFrame, value: str = "power_w", ms: str = "timestamp_ms") -> DataFrame:
    """Hourly mean per node; hours without readings give no row."""
    return (
        readings.groupBy("node_id", hour_ms(ms).alias("timestamp"))
        .agg(F.avg(value).alias(value))
        .where(F.col(value).isNotNull())
    )


def reduction(raw: DataFrame, hourly: DataFrame) -> DataFrame:
    """Row counts before and after the hourly rollup, and their ratio."""
    before = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    after = F.count(F.lit(1))
    return hourly.agg(
        before.alias("original_count"),
        after.alias("hourly_count"),
        F.when(after > 0, before / after).alias("reduction_ratio"),
    )


def interval_summary(summaries: DataFrame) -> DataFrame:
    """Average and peak power per node from window summaries, weighted by record count."""
    weight = F.sum("record_count")
    return summaries.groupBy("node_id").agg(
        (F.sum(F.col("avg_power") * F.col("record_count")) / weight).alias("avg_power"),
        F.max("max_power").alias("peak_power"),
        weight.alias("record_count"),
    )


def anomalies_per_node(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("node_id").agg(F.count(F.lit(1)).alias("anomaly_count"))


def severity_per_day(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy(utc_date("timestamp").alias("date"), "severity").agg(
        F.count(F.lit(1)).alias("anomaly_count")
    )
