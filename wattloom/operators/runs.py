"""Training-run log: best runs, recent runs, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The metric that decides promotion, per experiment.
PROMOTION_METRIC = {"load-forecasting": "test_mape", "anomaly-detection": "anomaly_rate"}
BEST_RUNS = 10


def _metric(name: str) -> Column:
    return F.try_element_at("metrics", F.lit(name))


def compare_runs(runs: DataFrame, experiment: str, metric: str) -> DataFrame:
    """All runs of an experiment, lowest metric first; runs without it come last."""
    return (
        runs.where(F.col("experiment") == experiment)
        .select("run_id", "experiment", "ts", _metric(metric).alias("metric"))
        .orderBy(F.asc_nulls_last("metric"), "ts", "run_id")
    )


def best_runs(runs: DataFrame, experiment: str, metric: str, limit: int = BEST_RUNS) -> DataFrame:
    return compare_runs(runs, experiment, metric).limit(limit)


def recent_runs(runs: DataFrame, experiment: str, limit: int = BEST_RUNS) -> DataFrame:
    return (
        runs.where(F.col("experiment") == experiment)
        .orderBy(F.desc("ts"), "run_id")
        .limit(limit)
        .select("run_id", "experiment", "ts")
    )


def promotions(runs: DataFrame, metrics: dict[str, str] | None = None) -> DataFrame:
    """Per experiment: is the newest run strictly better than the second-best run?

    A single run, or a run without a metric (no test window), is never promoted. The
    two best runs come from a limit-2 rank that Spark applies before its shuffle.
    """
    chosen = metrics or PROMOTION_METRIC
    name = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair])
    scored = runs.where(F.col("experiment").isin(list(chosen))).select(
        "experiment", "run_id", "ts",
        F.try_element_at("metrics", name[F.col("experiment")]).alias("metric"),
    )
    order = Window.partitionBy("experiment").orderBy(F.asc_nulls_last("metric"), "ts", "run_id")
    second = (
        scored.withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= 2)
        .where(F.col("rn") == 2)
        .select("experiment", F.col("metric").alias("runner_up"))
    )
    newest = (
        scored.groupBy("experiment")
        .agg(F.max(F.struct("ts", "run_id", "metric")).alias("r"), F.count(F.lit(1)).alias("runs"))
        .select("experiment", "r.run_id", "r.metric", "runs")
    )
    better = F.coalesce(F.col("metric") < F.col("runner_up"), F.lit(False))
    return newest.join(second, "experiment", "left").select(
        "experiment", "run_id", "runs", "metric", "runner_up",
        ((F.col("runs") > 1) & better).alias("promoted"),
    )


def scoring_metrics(predictions: DataFrame) -> DataFrame:
    """Counts and score statistics of scored readings."""
    n = F.count(F.lit(1))
    odd = F.count_if(F.col("severity") != "normal")
    return predictions.agg(
        n.alias("n_readings"),
        odd.alias("n_anomalies"),
        F.when(n > 0, F.bround(odd / n, 4)).alias("anomaly_rate"),
        F.bround(F.avg("anomaly_score"), 6).alias("mean_score"),
        F.bround(F.min("anomaly_score"), 6).alias("min_score"),
        F.bround(F.max("anomaly_score"), 6).alias("max_score"),
    )


def run_row(metrics: DataFrame, run_id: str, experiment: str, ts: int, params: dict) -> DataFrame:
    """A one-row metrics frame as a row of the run log."""
    pairs = [x for c in metrics.columns for x in (F.lit(c), F.col(c).cast("double"))]
    texts = [F.lit(str(x)) for pair in params.items() for x in pair]
    empty = F.create_map().cast("map<string,string>")
    return metrics.select(
        F.lit(run_id).alias("run_id"),
        F.lit(experiment).alias("experiment"),
        F.lit(ts).cast("bigint").alias("ts"),
        (F.create_map(*texts) if texts else empty).alias("params"),
        F.create_map(*pairs).alias("metrics"),
    )
