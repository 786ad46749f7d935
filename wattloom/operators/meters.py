"""Normalisation of two external meter datasets to the reading schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import (
    clip, half_even, kw_to_w, measured_or_derived_current, quarter_hour_kw_to_wh, to_double,
)
from ..functions.timecols import day_first_to_ms

# Source column names.
QUARTER_HOUR_COLUMNS = {
    "household_ID": "node_id",
    "timestamp": "timestamp_ms",
    "avgimportkw(kw)": "avg_import_kw",
    "phaseainstvoltage(v)": "voltage",
    "phaseainstcurrent(a)": "current",
    "powerfactor": "power_factor",
}
MINUTE_COLUMNS = [
    "Date", "Time", "Global_active_power", "Voltage", "Global_intensity",
    "Sub_metering_1", "Sub_metering_2", "Sub_metering_3",
]
MINUTE_NODE = "uci-household-main"
# Assumed power factor, its bounds, plausible volts, bounds of current.
POWER_FACTOR = 0.85
POWER_FACTOR_RANGE = (0.1, 1.0)
VOLTS = (200, 260)
AMPS = (0, 150)


def normalise_quarter_hour(raw: DataFrame) -> DataFrame:
    """15-minute meter rows (all text) to readings; implausible voltage is dropped."""
    named = raw.select(
        *[F.col(f"`{old}`").alias(new) for old, new in QUARTER_HOUR_COLUMNS.items()]
    )
    typed = named.select(
        "node_id",
        F.floor(to_double("timestamp_ms")).alias("timestamp_ms"),
        to_double("avg_import_kw").alias("kw"),
        to_double("voltage").alias("voltage"),
        to_double("current").alias("measured"),
        clip(F.coalesce(to_double("power_factor"), F.lit(POWER_FACTOR)), *POWER_FACTOR_RANGE).alias(
            "power_factor"
        ),
    ).dropna(subset=["timestamp_ms", "kw"])
    in_band = typed.where(F.col("voltage").between(*VOLTS))
    power = in_band.withColumn("power_w", kw_to_w("kw"))
    amps = measured_or_derived_current("measured", "power_w", "voltage", "power_factor")
    return power.select(
        "node_id",
        "timestamp_ms",
        F.timestamp_millis("timestamp_ms").alias("datetime"),
        "power_w",
        "voltage",
        clip(amps, *AMPS).alias("current"),
        quarter_hour_kw_to_wh("kw").alias("energy_wh"),
        "power_factor",
    )


def first_households(readings: DataFrame, n: int) -> DataFrame:
    """Readings of the ``n`` households that appear first (by time, then id)."""
    appeared = readings.groupBy("node_id").agg(F.min("timestamp_ms").alias("t"))
    keep = appeared.orderBy("t", "node_id").limit(n).select("node_id")
    return readings.join(keep, "node_id", "left_semi")


def normalise_minute(raw: DataFrame) -> DataFrame:
    """One household's per-minute rows (all text, ``?`` = missing) to readings."""
    present = raw.select(
        *[F.when(F.col(c) != "?", F.col(c)).alias(c) for c in MINUTE_COLUMNS]
    ).dropna()
    energy = sum((to_double(f"Sub_metering_{i}") for i in (2, 3)), to_double("Sub_metering_1"))
    return present.select(
        F.lit(MINUTE_NODE).alias("node_id"),
        day_first_to_ms("Date", "Time").alias("timestamp"),
        half_even(to_double("Voltage"), 2).alias("voltage"),
        half_even(to_double("Global_intensity"), 3).alias("current"),
        half_even(to_double("Global_active_power") * 1000.0, 2).alias("power"),
        half_even(energy, 4).alias("energy_wh"),
    )


def as_readings(quarter_hour: DataFrame) -> DataFrame:
    """Normalised 15-minute rows under the telemetry column names."""
    return quarter_hour.select(
        "node_id",
        F.col("timestamp_ms").alias("timestamp"),
        "voltage",
        "current",
        F.col("power_w").alias("power"),
        "energy_wh",
    )
