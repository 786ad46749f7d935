"""Recommendation rules over anomalies and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed, hour_list
from ..functions.timecols import last_hours, next_hours, utc_hour
from ..session import materialise
from .ranked import best_per_group, exact_quantile
from .serving import latest_forecasts

# Fixed values.
HIGH_WATTS = 800.0
PEAK_QUANTILE = 0.9
LOOKBACK_HOURS = 6
AHEAD_HOURS = 24
ANOMALY_TEXT = (
    "Node %s flagged with %s-severity anomaly (score %s). Inspect for irregular consumption."
)
CONSUMPTION_TEXT = "Node %s forecast exceeds %sW (peak: %sW). Review connected loads."
LOAD_SHIFT_TEXT = (
    "Node %s forecast shows peak consumption (%sW) at %s. "
    "Consider shifting deferrable loads to off-peak hours."
)

COLUMNS = [
    "node_id", "type", "severity", "message",
    "anomaly_score", "peak_hours", "max_consumption_watts", "metadata_json",
]


def recent_anomalies(anomalies: DataFrame, as_of_ms: int, hours: int = LOOKBACK_HOURS) -> DataFrame:
    return anomalies.where(last_hours("timestamp", as_of_ms, hours))


def upcoming_forecasts(forecasts: DataFrame, as_of_ms: int, hours: int = AHEAD_HOURS) -> DataFrame:
    return forecasts.where(next_hours("timestamp", as_of_ms, hours))


def worst_anomalies(anomalies: DataFrame) -> DataFrame:
    """The lowest score per node among high and medium anomalies."""
    serious = anomalies.where(F.col("severity").isin("high", "medium"))
    return best_per_group(
        serious.select("node_id", "score", "timestamp", "severity"), "node_id", "score", "timestamp"
    )


def _record(frame: DataFrame, kind: str, severity, message, **meta) -> DataFrame:
    """Shape one rule's rows; absent metadata is NULL and left out of the JSON."""
    types = {"anomaly_score": "double", "peak_hours": "array<int>", "max_consumption_watts": "double"}
    fields = [
        meta.get(name, F.lit(None)).cast(kind_).alias(name) for name, kind_ in types.items()
    ]
    present = [meta[name].cast(types[name]).alias(name) for name in types if name in meta]
    return frame.select(
        "node_id",
        F.lit(kind).alias("type"),
        severity.alias("severity"),
        message.alias("message"),
        *fields,
        F.to_json(F.struct(*present)).alias("metadata_json"),
    )


def anomaly_rule(anomalies: DataFrame) -> DataFrame:
    message = F.format_string(ANOMALY_TEXT, "node_id", "severity", fixed("score", 3))
    return _record(
        worst_anomalies(anomalies), "high_anomaly", F.col("severity"), message,
        anomaly_score=F.col("score"),
    )


def peak_per_node(forecasts: DataFrame, watts: float = HIGH_WATTS) -> DataFrame:
    """Highest forecast per node among values at or above the limit."""
    return (
        forecasts.where(F.col("predicted_consumption") >= watts)
        .groupBy("node_id")
        .agg(F.max("predicted_consumption").alias("peak"))
    )


def consumption_rule(forecasts: DataFrame, watts: float = HIGH_WATTS) -> DataFrame:
    limit = fixed(F.lit(float(watts)), 0)
    message = F.format_string(CONSUMPTION_TEXT, "node_id", limit, fixed("peak", 0))
    return _record(
        peak_per_node(forecasts, watts), "high_consumption", F.lit("high"), message,
        max_consumption_watts=F.col("peak"),
    )


def peak_hours(forecasts: DataFrame, q: float = PEAK_QUANTILE) -> DataFrame:
    """Hours of day (UTC, at most 24 per node) at or above the pooled quantile."""
    threshold = exact_quantile(forecasts, "predicted_consumption", q).scalar()
    return (
        forecasts.where(F.col("predicted_consumption") >= threshold)
        .groupBy("node_id")
        .agg(
            F.sort_array(F.collect_set(utc_hour("timestamp"))).alias("peak_hours"),
            F.max("predicted_consumption").alias("peak"),
        )
    )


def load_shift_rule(forecasts: DataFrame, q: float = PEAK_QUANTILE) -> DataFrame:
    message = F.format_string(
        LOAD_SHIFT_TEXT, "node_id", fixed("peak", 0), hour_list("peak_hours")
    )
    return _record(
        peak_hours(forecasts, q), "load_shift", F.lit("medium"), message,
        peak_hours=F.col("peak_hours"), max_consumption_watts=F.col("peak"),
    )


def combine(anomaly: DataFrame, consumption: DataFrame, load_shift: DataFrame) -> DataFrame:
    """All rules; a node with high consumption gets no load-shift advice."""
    kept = load_shift.join(consumption.select("node_id"), "node_id", "left_anti")
    return anomaly.unionByName(consumption).unionByName(kept).select(*COLUMNS)


def recommendations(
    anomalies: DataFrame,
    forecasts: DataFrame,
    as_of_ms: int,
    high_watts: float = HIGH_WATTS,
    quantile: float = PEAK_QUANTILE,
    lookback_hours: int = LOOKBACK_HOURS,
) -> DataFrame:
    """Recommendations at ``as_of_ms`` from stored anomalies and forecasts."""
    recent = recent_anomalies(anomalies, as_of_ms, lookback_hours)
    # A day of forecasts, read several times by the rules.
    ahead = materialise(latest_forecasts(upcoming_forecasts(forecasts, as_of_ms)))
    rules = combine(
        anomaly_rule(recent), consumption_rule(ahead, high_watts), load_shift_rule(ahead, quantile)
    )
    return rules.withColumn("generated_at", F.timestamp_millis(F.lit(as_of_ms)))
