"""Declared schemas of the stored tables and messages."""

from __future__ import annotations

from pyspark.sql import types as T


READING = (
    "node_id STRING, timestamp BIGINT, voltage DOUBLE, current DOUBLE, "
    "power DOUBLE, energy_wh DOUBLE"
)

# One DDL string per stored table; ``timestamp`` is epoch milliseconds (UTC).
TABLES = {
    "telemetry_readings": READING + ", created_at TIMESTAMP",
    "node_events": (
        "node_id STRING, node_type STRING, timestamp BIGINT, event_type STRING, "
        "severity STRING, message STRING, buffered BOOLEAN, created_at TIMESTAMP"
    ),
    "node_health": (
        "node_id STRING, node_type STRING, timestamp BIGINT, sequence_no INT, "
        "status STRING, uptime_sec INT, mqtt_connected BOOLEAN, "
        "wifi_connected BOOLEAN, sensor_ok BOOLEAN, buffered_count INT, "
        "created_at TIMESTAMP"
    ),
    "node_metadata": "node_id STRING, node_type STRING, location STRING",
    "anomaly_records": (
        "node_id STRING, timestamp BIGINT, anomaly_type STRING, score DOUBLE, "
        "severity STRING"
    ),
    "stream_summaries": (
        "node_id STRING, window_start BIGINT, window_end BIGINT, avg_power DOUBLE, "
        "max_power DOUBLE, avg_voltage DOUBLE, avg_current DOUBLE, "
        "avg_energy_wh DOUBLE, record_count INT"
    ),
    "forecasts": "node_id STRING, timestamp BIGINT, predicted_consumption DOUBLE",
    "energy_features": (
        "node_id STRING, timestamp BIGINT, avg_power DOUBLE, avg_voltage DOUBLE, "
        "avg_current DOUBLE, min_power DOUBLE, max_power DOUBLE, std_power DOUBLE, "
        "avg_energy_wh DOUBLE, reading_count INT, hour INT, day_of_week INT, "
        "day_of_month INT, lag_1h DOUBLE, lag_24h DOUBLE, lag_168h DOUBLE, "
        "rolling_avg_1d DOUBLE, rolling_avg_7d DOUBLE, rolling_avg_30d DOUBLE, "
        "rolling_min_24h DOUBLE, rolling_max_24h DOUBLE, rolling_std_24h DOUBLE, "
        "created_at TIMESTAMP, pipeline_version STRING, aggregation_level STRING"
    ),
    "energy_analytics_hourly": (
        "node_id STRING, division STRING, hour_start TIMESTAMP, "
        "total_consumption_wh DOUBLE, avg_power_w DOUBLE, peak_power_w DOUBLE, "
        "reading_count INT, created_at TIMESTAMP"
    ),
    "energy_analytics_daily": (
        "node_id STRING, division STRING, date DATE, total_consumption_wh DOUBLE, "
        "avg_power_w DOUBLE, peak_power_w DOUBLE, reading_count INT, created_at TIMESTAMP"
    ),
    "points": (
        "node_id STRING, timestamp BIGINT, voltage DOUBLE, current DOUBLE, power DOUBLE, "
        "energy_wh DOUBLE"
    ),
    "rejected": "value STRING, reason STRING, arrived BIGINT",
    "runs": (
        "run_id STRING, experiment STRING, ts BIGINT, "
        "params MAP<STRING,STRING>, metrics MAP<STRING,DOUBLE>"
    ),
}

# Columns that identify a row of each keyed table.
KEYS = {
    "telemetry_readings": ["node_id", "timestamp"],
    "points": ["node_id", "timestamp"],
    "node_metadata": ["node_id"],
    "stream_summaries": ["node_id", "window_start"],
    "energy_features": ["node_id", "timestamp"],
    "energy_analytics_hourly": ["node_id", "hour_start"],
    "energy_analytics_daily": ["node_id", "date"],
}

READING_FIELDS = ["node_id", "timestamp", "voltage", "current", "power", "energy_wh"]
MEASURES = ["voltage", "current", "power", "energy_wh"]


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
