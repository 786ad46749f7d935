"""24-step load forecaster: one linear regression per horizon over the last 10 hours.

All horizons share their inputs, so ordinary least squares needs one pass: each task
adds up its part of the normal equations and of the range of values, Spark sums the parts,
and an 11 x 11 system is solved once. The model is a table of 24 rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import HOUR_MS, last_hours
from ..session import materialise
from .scaling import apply_min_max, invert_min_max
from .sequences import PRED_LEN, SEQ_LEN, latest_inputs

MODEL_SCHEMA = "horizon INT, intercept DOUBLE, weights ARRAY<DOUBLE>"


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _partial_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's share of the normal equations in watts, and of the range of all values."""
    total = np.zeros((SEQ_LEN + 1, SEQ_LEN + 1 + PRED_LEN))
    low, high = np.inf, -np.inf
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x, y = _matrix(batch["x"], SEQ_LEN), _matrix(batch["y"], PRED_LEN)
        design = np.hstack([np.ones((len(x), 1)), x])
        total += design.T @ np.hstack([design, y])
        low, high = min(low, x.min(), y.min()), max(high, x.max(), y.max())
    if low <= high:
        i, j = np.indices(total.shape, dtype=np.int32)
        columns = {"i": i.ravel(), "j": j.ravel(), "v": total.ravel()}
        n = total.size
        yield pa.RecordBatch.from_pydict(
            {**columns, "low": np.full(n, low), "high": np.full(n, high)}
        )


def _solve(products: pd.DataFrame) -> pd.DataFrame:
    table = products.pivot(index="i", columns="j", values="v").to_numpy()
    low, high = float(products["low"].min()), float(products["high"].max())
    span = high - low if high > low else 1.0
    # (1, x, y) in watts to (1, x, y) normalised is a linear map, so the sums go by it too.
    scale = np.eye(SEQ_LEN + 1 + PRED_LEN) / span
    scale[0, 0], scale[1:, 0] = 1.0, -low / span
    split = SEQ_LEN + 1
    table = scale[:split, :split] @ table @ scale.T
    solution = np.linalg.lstsq(table[:, :split], table[:, split:], rcond=None)[0]
    return pd.DataFrame(
        {
            "horizon": np.arange(PRED_LEN),
            "intercept": solution[0],
            "weights": [list(w) for w in solution[1:].T],
            "low": low,
            "high": high,
        }
    )


def fit_linear(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Least-squares model over normalised windows, and the range they are normalised by.

    One pass over windows in watts: the range is not known before its end, but the sums can be
    rescaled. No windows give an empty model and an empty range.
    """
    parts = windows.select("x", "y").mapInArrow(
        _partial_products, "i INT, j INT, v DOUBLE, low DOUBLE, high DOUBLE"
    )
    products = parts.groupBy("i", "j").agg(
        F.sum("v").alias("v"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    # 385 sums in all: one group holds them.
    fitted = materialise(
        products.groupBy().applyInPandas(_solve, MODEL_SCHEMA + ", low DOUBLE, high DOUBLE")
    )
    return fitted.drop("low", "high"), fitted.select("low", "high").limit(1)


def _with_predictions(frame: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``yhat`` from ``x``; outputs below zero become zero."""
    horizons = F.sort_array(F.collect_list(F.struct("horizon", "intercept", "weights")))

    def one(h: Column) -> Column:
        terms = F.zip_with(F.col("x"), h["weights"], lambda a, w: a * w)
        total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
        return F.greatest(F.lit(0.0), h["intercept"] + total)

    # The 24 model rows travel as one scalar value, not as a join.
    attached = frame.withColumn("_model", model.agg(horizons).scalar())
    return attached.withColumn("yhat", F.transform("_model", one)).drop("_model")


def predict(inputs: DataFrame, model: DataFrame, scaler: DataFrame) -> DataFrame:
    """Add ``yhat`` (24 values in watts, at least 0) to inputs ``x`` in watts."""
    scaled = apply_min_max(inputs, scaler, ["x"])
    return invert_min_max(_with_predictions(scaled, model), scaler, ["yhat"])


def predict_normalised(windows: DataFrame, model: DataFrame, scaler: DataFrame) -> DataFrame:
    """Normalised ``x``, ``y`` and ``yhat`` for evaluation."""
    return _with_predictions(apply_min_max(windows, scaler, ["x", "y"]), model)


def forecast(
    features: DataFrame, model: DataFrame, scaler: DataFrame, as_of_ms: int
) -> DataFrame:
    """Next 24 hourly values per node with 10 hourly rows in the last 11 hours."""
    recent = features.where(last_hours("timestamp", as_of_ms, SEQ_LEN + 1))
    return expand(predict(latest_inputs(recent), model, scaler), as_of_ms)


def expand(predicted: DataFrame, as_of_ms: int) -> DataFrame:
    """Prediction arrays to rows; the first value is for ``as_of_ms`` itself."""
    return predicted.select("node_id", F.posexplode("yhat").alias("pos", "value")).select(
        "node_id",
        (F.lit(as_of_ms) + F.col("pos").cast("bigint") * HOUR_MS).alias("timestamp"),
        F.col("value").alias("predicted_consumption"),
    )


def forecast_errors(evaluated: DataFrame) -> DataFrame:
    """RMSE and MAPE (a ratio) pooled over windows and horizons; NULL without windows."""
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)
    square = F.zip_with("y", "yhat", lambda t, p: (p - t) * (p - t))
    ratio = F.zip_with("y", "yhat", lambda t, p: F.abs((t - p) / (F.abs(t) + 1e-8)))
    sums = evaluated.select(
        total(square).alias("sq"), total(ratio).alias("ap"), F.size("y").alias("k")
    )
    n = F.sum("k")
    return sums.agg(
        F.sqrt(F.sum("sq") / n).alias("test_rmse"), (F.sum("ap") / n).alias("test_mape")
    )


def forecast_vs_actual(forecasts: DataFrame, features: DataFrame) -> DataFrame:
    """Forecasts next to the measured hourly value; NULL where none was measured."""
    hour = F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(HOUR_MS))
    actual = features.select("node_id", F.col("timestamp").alias("hour_ms"), "avg_power")
    joined = forecasts.withColumn("hour_ms", hour).join(actual, ["node_id", "hour_ms"], "left")
    return joined.select(
        "node_id",
        "timestamp",
        "predicted_consumption",
        "avg_power",
        (F.col("predicted_consumption") - F.col("avg_power")).alias("error"),
    )


def mean_model(spark: SparkSession) -> DataFrame:
    """A model that repeats the mean of the inputs; the yardstick for a fitted one."""
    weights = F.array_repeat(F.lit(1.0 / SEQ_LEN), SEQ_LEN)
    return spark.range(PRED_LEN).select(
        F.col("id").cast("int").alias("horizon"),
        F.lit(0.0).alias("intercept"),
        weights.alias("weights"),
    )
