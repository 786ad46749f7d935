"""Storage of streamed records with first-write-wins keys.

Tables are partitioned by day. Every stored row carries the name of its micro-batch, which contains the
id of the stream that its checkpoint keeps. A retried batch therefore finds its own rows and adds none
twice. Offsets are committed only after all writes succeeded. Each sink is the only writer of its
tables; after every ``TIDY_EVERY`` batches it merges the small files of the days it wrote to, so the
files of a day stay few however many batches write into it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.messages import judge_ingest, route
from ..schemas import KEYS, MEASURES, schema
from ..sources.tables import BATCH, DAY, compact_days, insert_rows

log = logging.getLogger(__name__)

TIDY_EVERY = 32
PLACE = "place"  # where a message came from, as text; the key of records that have none

Secondary = Callable[[DataFrame], None]


def batch_name(spark: SparkSession, batch_id: int) -> str:
    stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "manual"
    return f"{stream}-{batch_id:012d}"


class Tables:
    """The tables of one sink: inserts, and now and then a merge of small files."""

    def __init__(self) -> None:
        self.batches: dict[str, int] = {}
        self.spans: dict[str, tuple[date, date]] = {}

    def insert(
        self,
        rows: DataFrame,
        path: str,
        table: str,
        order: str,
        batch: str,
        time: str = "timestamp",
        keys: list[str] | None = None,
    ) -> DataFrame:
        """Insert rows whose key is not stored yet; returns the stored rows of this batch."""
        done = self.batches.get(path, 0)
        if done and done % TIDY_EVERY == 0 and path in self.spans:
            compact_days(rows.sparkSession, path, self.spans.pop(path), TIDY_EVERY // 2)
        self.batches[path] = done + 1
        inserted, span = insert_rows(rows, path, table, keys or KEYS[table], order, batch, time)
        if span is not None:
            old = self.spans.get(path, span)
            self.spans[path] = (min(span[0], old[0]), max(span[1], old[1]))
        return inserted


def place_text(seq: str = "seq") -> Column:
    """A message's place as one text."""
    return F.concat_ws("/", f"{seq}.topic", f"{seq}.partition", f"{seq}.offset")


class TelemetrySink:
    """Validate, store, then pass the batch's stored rows to the secondary sink.

    Invalid messages go to ``rejected`` with their reason, by the day they arrived. A failing primary
    write raises, so the batch is retried. A failing secondary write is logged and dropped.
    """

    def __init__(self, path: str, rejected: str, secondary: Secondary | None = None):
        self.path, self.rejected, self.secondary = path, rejected, secondary
        self.tables = Tables()

    def __call__(self, messages: DataFrame, batch_id: int) -> None:
        judged = judge_ingest(messages).persist()
        try:
            self.store(judged, batch_id)
        finally:
            judged.unpersist()

    def store(self, judged: DataFrame, batch_id: int) -> None:
        """Store messages that carry their verdict already."""
        batch = batch_name(judged.sparkSession, batch_id)
        bad = judged.where(F.col("reason").isNotNull()).select(
            "value",
            "reason",
            F.unix_millis(F.current_timestamp()).alias("arrived"),
            place_text().alias(PLACE),
            "seq",
        )
        self.tables.insert(bad, self.rejected, "rejected", "seq", batch, "arrived", [BATCH, PLACE])
        good = judged.where(F.col("reason").isNull()).select("data.*", "seq")
        stamped = good.withColumn("created_at", F.current_timestamp())
        inserted = self.tables.insert(stamped, self.path, "telemetry_readings", "seq", batch)
        if self.secondary is not None:
            try:
                self.secondary(inserted)
            except Exception:
                log.warning("secondary write of batch %s failed", batch, exc_info=True)


def telemetry_sink(path: str, rejected: str, secondary: Secondary | None = None) -> TelemetrySink:
    return TelemetrySink(path, rejected, secondary)


def points_sink(path: str) -> Secondary:
    """Time-series points: node, four measures, millisecond time. A point is stored once."""
    tables = Tables()

    def write(inserted: DataFrame) -> None:
        measures = [F.col(m).cast("double").alias(m) for m in MEASURES]
        points = inserted.select("node_id", "timestamp", *measures)
        points = points.withColumn("seq", F.col("timestamp"))
        tables.insert(points, path, "points", "seq", batch_name(inserted.sparkSession, 0))

    return write


def summary_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Store window summaries, first per node and window start."""
    tables = Tables()

    def write(summaries: DataFrame, batch_id: int) -> None:
        batch = batch_name(summaries.sparkSession, batch_id)
        ordered = summaries.withColumn("seq", F.col("window_end")).persist()
        try:
            tables.insert(ordered, path, "stream_summaries", "seq", batch, "window_start")
        finally:
            ordered.unpersist()

    return write


def device_records(messages: DataFrame, table: str) -> DataFrame:
    """Event or health payloads (passed through unvalidated) under the table's schema."""
    fields = schema(table)
    wanted = [f.name for f in fields if f.name != "created_at"]
    parsed = messages.select(
        F.from_json("value", fields).alias("r"), "seq", place_text().alias(PLACE)
    )
    stamp = F.current_timestamp().alias("created_at")
    return parsed.select(*(f"r.{c}" for c in wanted), stamp, "seq", PLACE)


def routed(messages: DataFrame) -> dict[str, DataFrame]:
    """Device messages by topic suffix: judged telemetry that is valid, events, health.

    Messages of other topics and unparsable payloads are dropped.
    """
    kinds = messages.withColumn("kind", route("topic"))
    parsable = F.try_parse_json("value").isNotNull()
    of = lambda kind: kinds.where(F.col("kind") == kind).drop("kind")
    return {
        "telemetry": judge_ingest(of("telemetry")).where(F.col("reason").isNull()),
        "events": of("events").where(parsable),
        "health": of("health").where(parsable),
    }


def router_sink(
    telemetry: TelemetrySink, events_path: str, health_path: str
) -> Callable[[DataFrame, int], None]:
    """One pass over device topics: telemetry to its sink, events and health to tables.

    A telemetry message is parsed once; the sink gets it with its verdict.
    """
    tables = Tables()

    def write(messages: DataFrame, batch_id: int) -> None:
        batch = batch_name(messages.sparkSession, batch_id)
        messages.persist()
        parts = routed(messages)
        judged = parts["telemetry"].persist()
        try:
            telemetry.store(judged, batch_id)
            for kind, table, path in (
                ("events", "node_events", events_path),
                ("health", "node_health", health_path),
            ):
                records = device_records(parts[kind], table)
                tables.insert(records, path, table, "seq", batch, keys=[BATCH, PLACE])
        finally:
            judged.unpersist()
            messages.unpersist()

    return write


def start_sink(
    messages: DataFrame, sink, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Run a sink; meters report once a minute, so that is the default batch interval."""
    return (
        messages.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )
