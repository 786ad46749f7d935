"""Two-second window summaries per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.messages import SUMMARY_FIELDS, envelope, has_fields, to_message, valid_records

WIDTH = "2 seconds"  # fixed value
DELAY = "10 seconds"


def summarise(
    records: DataFrame,
    width: str = WIDTH,
    delay: str = DELAY,
    processing_time: bool = False,
    dedupe: bool = False,
) -> DataFrame:
    """Summaries of typed readings; works on streams and on stored readings.

    Event time comes from the payload, so a replayed reading lands in its own window;
    records later than the watermark are left out of the windows. With
    ``processing_time`` the arrival time counts instead. Aggregation is incremental:
    the state holds sums and counts, not the records.
    """
    clock = F.current_timestamp() if processing_time else F.timestamp_millis("timestamp")
    timed = records.withColumn("event_time", clock).withWatermark("event_time", delay)
    if dedupe:
        timed = timed.dropDuplicatesWithinWatermark(["node_id", "timestamp"])
    return (
        timed.groupBy(F.window("event_time", width).alias("w"), "node_id")
        .agg(
            F.avg("power").alias("avg_power"),
            F.max("power").alias("max_power"),
            F.avg("voltage").alias("avg_voltage"),
            F.avg("current").alias("avg_current"),
            F.avg("energy_wh").alias("avg_energy_wh"),
            F.count(F.lit(1)).cast("int").alias("record_count"),
        )
        .select(
            F.unix_millis("w.start").alias("window_start"),
            F.unix_millis("w.end").alias("window_end"),
            "node_id", "avg_power", "max_power", "avg_voltage", "avg_current",
            "avg_energy_wh", "record_count",
        )
    )


def summarise_messages(messages: DataFrame, **options) -> DataFrame:
    """Raw JSON messages to summaries: judge, keep valid, unwrap, window."""
    return summarise(valid_records(envelope(messages)), **options)


def start_window_job(
    messages: DataFrame, sink, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Run the window job; ``sink(frame, batch_id)`` receives finished windows."""
    return (
        summarise_messages(messages, **options)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
        .trigger(**(trigger or {"processingTime": WIDTH}))
        .start()
    )


def summary_messages(summaries: DataFrame) -> DataFrame:
    return to_message(summaries)


def live_feed(messages: DataFrame) -> DataFrame:
    """Summary messages that hold all required fields."""
    return messages.where(has_fields("value", SUMMARY_FIELDS))
