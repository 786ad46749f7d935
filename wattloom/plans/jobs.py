"""Batch jobs. Time is an argument (``as_of_ms``), so every run can be repeated."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timecols import DAY_MS, last_days
from ..operators import features as feat
from ..operators import forecasting, nodes, quality, rollups, runs, sequences
from ..operators import isolation_forest as forest
from ..operators.retention import RETENTION_DAYS
from ..operators.serving import before_ms, between_ms
from ..session import materialise
from ..sources.tables import (
    DAY,
    NO_DAY,
    day_folders,
    purge_rows,
    read_days,
    replace_days,
    with_day,
)

LOOKBACK_DAYS = 30  # fixed value


class ValidationFailed(ValueError):
    """A validation interval holds failing readings."""


def batch_analytics(
    telemetry: DataFrame,
    metadata: DataFrame,
    hourly_path: str,
    daily_path: str,
    since_ms: int | None = None,
):
    """Hourly and daily rollups from one scan of the readings, from ``since_ms`` (a day start) on.

    The hourly sums are computed once into the shared checkpoint folder and feed both
    tables; each table replaces only the days it covers.
    """
    pruned = telemetry if since_ms is None else between_ms(telemetry, since_ms, None)
    pruned = pruned.select("node_id", "timestamp", "power", "energy_wh")
    partials = materialise(rollups.hourly_partials(pruned))
    stamp = F.current_timestamp()
    hourly = rollups.hourly_from_partials(partials, metadata).withColumn("created_at", stamp)
    replace_days(with_day(hourly, "hour_ms").drop("hour_ms"), hourly_path)
    daily = rollups.daily_from_partials(partials, metadata).withColumn("created_at", stamp)
    replace_days(daily.withColumn(DAY, F.col("date")), daily_path)


def _history(stored: DataFrame, fresh: DataFrame, since_ms: int) -> DataFrame:
    """Stored hours that values from ``since_ms`` on depend on: those within the longest rolling
    frame, and for nodes with fewer than the longest lag's rows in it, so many rows from before."""
    edge = since_ms - LOOKBACK_DAYS * DAY_MS
    recent = between_ms(stored, edge, since_ms)
    rows = max(feat.LAG_ROWS.values())
    counts = recent.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    short = (
        fresh.select("node_id")
        .distinct()
        .join(counts, "node_id", "left")
        .where(F.coalesce("n", F.lit(0)) < rows)
        .select("node_id")
    )
    newest = Window.partitionBy("node_id").orderBy(F.desc("timestamp"))
    older = (
        before_ms(stored, edge)
        .join(short, "node_id", "left_semi")
        .withColumn("back", F.row_number().over(newest))
        .where(F.col("back") <= rows)
        .drop("back")
    )
    return recent.unionByName(older).select(*fresh.columns)


def feature_job(telemetry: DataFrame, path: str, since_ms: int | None = None) -> DataFrame:
    """Hourly features, written by day; returns the quality counts of the rows written.

    With ``since_ms`` (a day start) only readings from that day on are aggregated. Lags
    and rolling values of the new hours then use the hourly measures already stored,
    which gives the same rows as recomputing everything without scanning old readings.
    """
    spark = telemetry.sparkSession
    if since_ms is None:
        features = feat.engineer_features(feat.hourly_features(telemetry))
    else:
        fresh = feat.hourly_features(between_ms(telemetry, since_ms, None))
        stored = read_days(spark, path, "energy_features")
        # Written before the table it was read from is replaced.
        hourly = materialise(_history(stored, fresh, since_ms).unionByName(fresh))
        features = feat.engineer_features(hourly).where(F.col("timestamp") >= since_ms)
    replace_days(with_day(features.drop("feature_timestamp")), path)
    written = read_days(spark, path, "energy_features")
    return feat.feature_quality(between_ms(written, since_ms or 0, None))


def resume_ms(spark: SparkSession, path: str) -> int | None:
    """Start of the newest day stored in a table: where the next daily run begins. That day may have
    been incomplete and is computed again. None when nothing is stored."""
    days = [f.rsplit("=", 1)[1] for f in day_folders(spark, path) if not f.endswith(NO_DAY)]
    if not days:
        return None
    return (date.fromisoformat(max(days)) - date(1970, 1, 1)).days * DAY_MS


def daily_run(
    telemetry: DataFrame,
    metadata: DataFrame,
    features_path: str,
    hourly_path: str,
    daily_path: str,
    since_ms: int | None = None,
) -> DataFrame:
    """Features first, then analytics; all days, or those from ``since_ms`` (a day start) on."""
    report = feature_job(telemetry, features_path, since_ms)
    batch_analytics(telemetry, metadata, hourly_path, daily_path, since_ms)
    return report


def retention_job(
    spark: SparkSession, paths: dict[str, str], as_of_ms: int, days: int = RETENTION_DAYS
) -> DataFrame:
    """Delete the expired rows of the named tables; a row per table and one ``total``."""
    deleted = {name: purge_rows(spark, path, name, as_of_ms, days) for name, path in paths.items()}
    rows = [*deleted.items(), ("total", sum(deleted.values()))]
    return spark.createDataFrame(rows, "table_name STRING, deleted BIGINT")


def validation_gate(readings: DataFrame, start: str, end: str) -> DataFrame:
    """Validate the readings created in one interval; raise when any fails."""
    interval = quality.arrival_interval(
        readings, F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    )
    summary = quality.validation_summary(interval.drop("created_at"), start, end)
    row = summary.first()
    if row["failed"] > 0:
        raise ValidationFailed(f"Telemetry validation failed: {row.asDict()}")
    return summary


def train_detector(
    readings: DataFrame,
    model_path: str,
    run_id: str,
    model_ts: int,
    contamination: float = forest.CONTAMINATION,
    dataset: str = "telemetry",
) -> DataFrame:
    """Fit, store, score the training readings; returns the run's row for the run log."""
    forest.fit_and_save(readings, model_path, model_ts, contamination)
    scored = forest.detect(readings, forest.load(readings.sparkSession, model_path))
    params = {
        "contamination": contamination,
        "n_estimators": forest.TREES,
        "random_state": forest.SEED,
        "dataset": dataset,
    }
    metrics = runs.scoring_metrics(scored)
    return runs.run_row(metrics, run_id, "anomaly-detection", model_ts, params)


def retrain_detector(telemetry: DataFrame, model_path: str, run_id: str, as_of_ms: int) -> DataFrame:
    """Weekly retraining on the last 30 days."""
    recent = telemetry.where(last_days("timestamp", as_of_ms, LOOKBACK_DAYS))
    return train_detector(recent, model_path, run_id, as_of_ms, forest.JOB_CONTAMINATION)


def train_forecaster(hourly: DataFrame, stride: int = sequences.TRAIN_STRIDE):
    """Model and scaler tables from hourly rows ``(node_id, timestamp, avg_power)``."""
    model, scaler = forecasting.fit_linear(sequences.sliding_windows(hourly, stride=stride))
    if model.isEmpty():
        raise ValueError(
            f"training needs {sequences.WINDOW} hourly values in a row of at least one node"
        )
    return model, scaler


def retrain_forecaster(features: DataFrame, run_id: str, as_of_ms: int):
    """Train on the older 80 % of each node's last 30 days, evaluate on the rest.

    Returns model, scaler and the run's row for the run log.
    """
    recent = features.where(last_days("timestamp", as_of_ms, LOOKBACK_DAYS))
    split = materialise(sequences.time_split(recent.select("node_id", "timestamp", "avg_power")))
    model, scaler = train_forecaster(split.where(F.col("split") == "train"))
    held_out = sequences.sliding_windows(split.where(F.col("split") == "test"), stride=1)
    errors = forecasting.forecast_errors(
        forecasting.predict_normalised(held_out, model, scaler)
    )
    params = {
        "seq_len": sequences.SEQ_LEN,
        "pred_len": sequences.PRED_LEN,
        "lookback_days": LOOKBACK_DAYS,
    }
    return model, scaler, runs.run_row(errors, run_id, "load-forecasting", as_of_ms, params)


def forecast_job(
    features: DataFrame,
    as_of_ms: int,
    path: str,
    model: DataFrame | None = None,
    scaler: DataFrame | None = None,
) -> DataFrame:
    """Forecast the next 24 hours, training first when there is no model.

    Returns one row: ``status`` and the number of forecasts written. Each run writes
    its own ``run_ts`` partition; readers take the latest run per node and time.
    """
    spark = features.sparkSession
    if model is None or scaler is None:
        if not nodes.forecaster_readiness(features).first()["ready"]:
            return spark.range(1).select(
                F.lit("not_enough_data").alias("status"), F.lit(0).cast("bigint").alias("rows")
            )
        model, scaler = train_forecaster(features.where(F.col("avg_power").isNotNull()))
    predicted = forecasting.forecast(features, model, scaler, as_of_ms)
    replace_days(predicted.withColumn("run_ts", F.lit(as_of_ms)), path, ["run_ts"])
    written = spark.read.parquet(path).where(F.col("run_ts") == as_of_ms)
    count = F.count(F.lit(1))
    return written.agg(
        F.when(count > 0, "success").otherwise("no_forecasts").alias("status"),
        count.alias("rows"),
    )


def training_snapshot(features: DataFrame, telemetry: DataFrame, as_of_ms: int):
    """The last 30 days of features and readings."""
    recent = last_days("timestamp", as_of_ms, LOOKBACK_DAYS)
    return features.where(recent), telemetry.where(recent)


def log_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").parquet(path)
