"""Message topics. The same downstream code accepts files of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.messages import to_message

# Topic names.
TELEMETRY = "energy.telemetry"
EVENTS = "energy.events"
HEALTH = "energy.health"
RESULTS = "energy.telemetry.results"
ANOMALIES = "energy.anomalies"


def topic_options(servers: str, topic: str, start: str = "earliest") -> dict[str, str]:
    """``earliest`` for storage, windows and scoring; ``latest`` for the live feed."""
    if start not in ("earliest", "latest"):
        raise ValueError("start must be 'earliest' or 'latest'")
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": start,
        "failOnDataLoss": "true",
    }


def place(topic: str, partition: Column, offset: Column) -> Column:
    return F.struct(
        F.col(topic).alias("topic"),
        partition.cast("int").alias("partition"),
        offset.cast("bigint").alias("offset"),
    )


def read_topic(
    spark: SparkSession, servers: str, topic: str, start: str = "earliest", **extra: str
) -> DataFrame:
    """Unbounded ``value``, ``topic`` and ``seq``, the message's place: topic, partition, offset.

    That is unique over all topics and partitions, so the first of two equal keys is the same
    however the messages are dealt out.
    """
    options = {**topic_options(servers, topic, start), **extra}
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(
        F.col("value").cast("string").alias("value"),
        "topic",
        place("topic", F.col("partition"), F.col("offset")).alias("seq"),
    )


def read_message_files(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """Unbounded JSON lines ``{"topic", "seq", "value"}`` from a folder; ``seq`` counts per topic."""
    reader = spark.readStream.schema("topic STRING, seq BIGINT, value STRING")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).withColumn("seq", place("topic", F.lit(0), F.col("seq")))


def write_topic(frame: DataFrame, servers: str, topic: str, checkpoint: str):
    """Rows as JSON values; the checkpoint makes delivery at least once."""
    return (
        to_message(frame)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def send_batch(frame: DataFrame, servers: str, topic: str) -> None:
    (
        to_message(frame)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
