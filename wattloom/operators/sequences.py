"""Fixed-length sequences over hourly rows, for the forecaster.

Windows are per node over hourly rows (bounded by hours of history, see features).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Input length, forecast length, training stride, held-out share.
SEQ_LEN = 10
PRED_LEN = 24
WINDOW = SEQ_LEN + PRED_LEN
TRAIN_STRIDE = 2
TEST_SHARE = 0.2


def _by_node() -> Window:
    return Window.partitionBy("node_id").orderBy("timestamp")


def sliding_windows(hourly: DataFrame, value: str = "avg_power", stride: int = 1) -> DataFrame:
    """One row per window start: ``start_ms``, ``x`` (10 inputs), ``y`` (24 targets).

    Hours without a value are left out first, as they are from :func:`sequence_count`. Starts step by
    ``stride`` rows; a node with fewer than 34 rows gives none.
    """
    ahead = _by_node().rowsBetween(0, WINDOW - 1)
    windows = hourly.where(F.col(value).isNotNull()).select(
        "node_id",
        F.col("timestamp").alias("start_ms"),
        (F.row_number().over(_by_node()) - 1).alias("pos"),
        F.collect_list(F.col(value).cast("double")).over(ahead).alias("w"),
    )
    full = (F.size("w") == WINDOW) & (F.col("pos") % stride == 0)
    return windows.where(full).select(
        "node_id",
        "start_ms",
        F.slice("w", 1, SEQ_LEN).alias("x"),
        F.slice("w", SEQ_LEN + 1, PRED_LEN).alias("y"),
    )


def latest_inputs(hourly: DataFrame, value: str = "avg_power", length: int = SEQ_LEN) -> DataFrame:
    """The last ``length`` values per node in time order; shorter nodes are skipped."""
    newest = Window.partitionBy("node_id").orderBy(F.desc("timestamp"))
    tail = hourly.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= length)
    ordered = F.sort_array(F.collect_list(F.struct("timestamp", F.col(value).alias("v"))))
    return (
        tail.groupBy("node_id")
        .agg(ordered.alias("rows"))
        .where(F.size("rows") == length)
        .select("node_id", F.col("rows.v").alias("x"))
    )


def time_split(hourly: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """Mark the oldest rows of each node ``train`` and the rest ``test``."""
    count = F.count(F.lit(1)).over(Window.partitionBy("node_id"))
    keep = F.floor(count * F.lit(1.0 - test_share))
    return hourly.withColumn(
        "split",
        F.when(F.row_number().over(_by_node()) <= keep, "train").otherwise("test"),
    )


def sequence_count(hourly: DataFrame, value: str = "avg_power") -> DataFrame:
    """Number of stride-1 windows over all nodes."""
    per_node = hourly.groupBy("node_id").agg(F.count(value).alias("n"))
    return per_node.agg(
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n") - WINDOW + 1)), F.lit(0)).alias(
            "n_sequences"
        )
    )


def shuffled(windows: DataFrame, seed: int = 42) -> DataFrame:
    """Reproducible order, independent of partitioning."""
    return windows.orderBy(F.xxhash64("node_id", "start_ms", F.lit(seed)), "node_id", "start_ms")
