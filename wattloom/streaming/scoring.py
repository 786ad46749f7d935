"""Scoring of streamed readings: learning gate, model, non-normal results."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.messages import judge_ingest
from ..functions.severity import is_anomalous
from ..operators import isolation_forest as forest
from ..operators.nodes import detector_readiness, first_seen, past_learning
from ..session import materialise
from ..sources.tables import BATCH, read_days
from .storage import TIDY_EVERY, Tables, batch_name

log = logging.getLogger(__name__)

# Fixed values.
ANOMALY_TYPE = "unusual_time_window_usage"
RETRY_SECONDS = 3600.0
SEEN_SCHEMA = "node_id STRING, first_seen_ms BIGINT"
GENERATION = "generation"


def now_ms() -> int:
    return int(time.time() * 1000)


def _generations(spark: SparkSession, path: str) -> list[int]:
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(to_path(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(to_path(path))]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{GENERATION}="))


def read_first_seen(spark: SparkSession, path: str) -> DataFrame:
    """Earliest reading per node from the stored rows, of which a node may have several."""
    if not _generations(spark, path):
        return spark.createDataFrame([], SEEN_SCHEMA)
    stored = spark.read.schema(SEEN_SCHEMA).parquet(path)
    return stored.groupBy("node_id").agg(F.min("first_seen_ms").alias("first_seen_ms"))


def compact_first_seen(spark: SparkSession, path: str) -> None:
    """One row per node in a new generation; then the older ones go. If that is cut short, both are
    read, which gives the same minimum."""
    older = _generations(spark, path)
    if not older:
        return
    read_first_seen(spark, path).write.parquet(f"{path}/{GENERATION}={older[-1] + 1}")
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in older:
        fs.delete(to_path(f"{path}/{GENERATION}={n}"), True)


def update_first_seen(readings: DataFrame, path: str) -> DataFrame:
    """Store nodes that are new or seen earlier than known; returns the batch's nodes.

    Only changes are written, and only the batch's nodes are looked up, once. Writing a change again,
    as a retry does, changes no minimum. The table outlives the retention of readings, so graduation
    is permanent.
    """
    spark = readings.sparkSession
    nodes_here = first_seen(readings)
    if not _generations(spark, path):
        stored = spark.createDataFrame([], SEEN_SCHEMA)
    else:
        stored = spark.read.schema(SEEN_SCHEMA).parquet(path)
    known = (
        stored.join(nodes_here.select("node_id"), "node_id", "left_semi")
        .groupBy("node_id")
        .agg(F.min("first_seen_ms").alias("known_ms"))
    )
    # A row per node of the batch, kept because the table changes under it.
    merged = materialise(nodes_here.join(known, "node_id", "left"))
    changed = merged.where(F.col("known_ms").isNull() | (F.col("first_seen_ms") < F.col("known_ms")))
    at = (_generations(spark, path) or [0])[-1]
    changed.select("node_id", "first_seen_ms").write.mode("append").parquet(
        f"{path}/{GENERATION}={at}"
    )
    return merged.select(
        "node_id", F.least("first_seen_ms", "known_ms").alias("first_seen_ms")
    )


def anomalies_of(scored: DataFrame) -> DataFrame:
    """Non-normal results under the record schema."""
    return scored.where(is_anomalous()).select(
        "node_id",
        "timestamp",
        F.lit(ANOMALY_TYPE).alias("anomaly_type"),
        F.col("anomaly_score").alias("score"),
        "severity",
    )


def scoring_sink(
    model_path: str,
    seen_path: str,
    telemetry_path: str,
    records_path: str,
    send: Callable[[DataFrame], None] | None = None,
    clock: Callable[[], int] = now_ms,
    contamination: float = forest.JOB_CONTAMINATION,
) -> Callable[[DataFrame, int], None]:
    """Score the readings of nodes past their learning period.

    Without a stored model, training is tried at most hourly until the stored
    readings suffice. Results are stored and, when ``send`` is given, published.
    """
    state = {"tried": float("-inf"), "batches": 0}
    tables = Tables()

    def model(spark: SparkSession) -> DataFrame | None:
        try:
            return forest.load(spark, model_path)
        except RuntimeError:
            pass
        if clock() / 1000 - state["tried"] < RETRY_SECONDS:
            return None
        state["tried"] = clock() / 1000
        stored = read_days(spark, telemetry_path, "telemetry_readings", [BATCH])
        if not detector_readiness(stored).first()["ready"]:
            log.info("not enough stored readings to train a detector yet")
            return None
        forest.fit_and_save(stored, model_path, clock(), contamination)
        return forest.load(spark, model_path)

    def write(messages: DataFrame, batch_id: int) -> None:
        spark = messages.sparkSession
        batch = batch_name(spark, batch_id)
        judged = judge_ingest(messages).where(F.col("reason").isNull())
        readings = judged.select("data.*").persist()
        try:
            state["batches"] += 1
            if state["batches"] % TIDY_EVERY == 0:
                compact_first_seen(spark, seen_path)
            seen = update_first_seen(readings, seen_path)
            cells = model(spark)
            if cells is None:
                return
            scored = forest.detect(past_learning(readings, seen, clock()), cells)
            # A reading scored twice in a batch is one record.
            found = anomalies_of(scored).dropDuplicates(["node_id", "timestamp"]).persist()
            ordered = found.withColumn("seq", F.col("timestamp"))
            tables.insert(
                ordered, records_path, "anomaly_records", "seq", batch,
                keys=[BATCH, "node_id", "timestamp"],
            )
            if send is not None:
                send(found.withColumnRenamed("score", "anomaly_score"))
            found.unpersist()
        finally:
            readings.unpersist()

    return write
