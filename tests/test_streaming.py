import json
import os

import pytest
from pyspark.sql import functions as F

from wattloom.functions.timecols import DAY_MS, HOUR_MS
from wattloom.schemas import READING
from wattloom.sources import tables, topics
from wattloom.streaming import scoring, storage, windows

BASE = 1_712_908_800_000
ONCE = {"availableNow": True}


def record(ms=BASE, node="plug_01", **changes):
    full = {"node_id": node, "timestamp": ms, "voltage": 230.0, "current": 1.0,
            "power": 100.0, "energy_wh": 5.0, **changes}
    return json.dumps(full)


class Feed:
    """Message files that a stream picks up."""

    def __init__(self, folder):
        self.path, self.sent = folder + "/in", 0
        os.makedirs(self.path)

    def send(self, *values, topic="energy/nodes/plug_01/telemetry"):
        path = f"{self.path}/{self.sent:04d}.json"
        with open(path, "w") as out:
            for i, value in enumerate(values):
                out.write(json.dumps({"topic": topic, "seq": self.sent * 1000 + i, "value": value}) + "\n")
        os.utime(path, (1_700_000_000 + self.sent,) * 2)  # files are read in time order
        self.sent += 1

    def stream(self, spark):
        return topics.read_message_files(spark, self.path, files_per_batch=1)


@pytest.fixture()
def feed(folder):
    return Feed(folder)


def run(query):
    query.awaitTermination(300)
    assert query.exception() is None


def collector():
    rows = []
    return rows, lambda frame, _: rows.extend(frame.collect())


def test_replayed_records_land_in_their_own_window(spark, feed, folder):
    feed.send(record(BASE), record(BASE + 1000), record(BASE + 5000))
    feed.send(record(BASE + 60_000))  # closes the earlier windows
    rows, sink = collector()
    run(windows.start_window_job(feed.stream(spark), sink, folder + "/c", ONCE))
    got = {(r["window_start"], r["record_count"]) for r in rows}
    assert got == {(BASE, 2), (BASE + 4000, 1)}


def test_late_duplicate_and_broken_messages(spark, feed, folder):
    feed.send(record(BASE), record(BASE), "{bad", "", record(BASE, power=-1))
    feed.send(record(BASE + 30_000, power=300.0))
    feed.send(record(BASE + 31_000, power=500.0))
    feed.send(record(BASE + 500))  # later than the watermark of the batch before: no window
    feed.send(record(BASE + 90_000))
    rows, sink = collector()
    query = windows.start_window_job(
        feed.stream(spark), sink, folder + "/c", ONCE, delay="10 seconds", dedupe=True
    )
    run(query)
    got = {(r["window_start"], r["record_count"], r["avg_power"]) for r in rows}
    assert got == {(BASE, 1, 100.0), (BASE + 30_000, 2, 400.0)}


def test_stream_equals_batch(spark, feed, folder):
    values = [record(BASE + i * 700, f"n{i % 3}", power=float(i)) for i in range(200)]
    for i in range(0, 200, 50):
        feed.send(*values[i : i + 50])
    feed.send(record(BASE + DAY_MS, "closing"))
    rows, sink = collector()
    run(windows.start_window_job(feed.stream(spark), sink, folder + "/c", ONCE))
    batch = windows.summarise(
        spark.createDataFrame([(v,) for v in values], "value STRING")
        .select(F.from_json("value", READING).alias("r")).select("r.*")
    )
    assert {tuple(r) for r in rows} == {tuple(r) for r in batch.collect()}


def test_processing_time_mode(spark, feed, folder):
    feed.send(record(BASE), record(BASE + DAY_MS))
    rows, sink = collector()
    query = windows.summarise_messages(feed.stream(spark), processing_time=True)
    run(
        query.writeStream.outputMode("update").option("checkpointLocation", folder + "/c")
        .foreachBatch(sink).trigger(**ONCE).start()
    )
    assert sum(r["record_count"] for r in rows) == 2
    assert len({r["window_start"] for r in rows}) == 1


def stored(spark, path):
    return tables.read_days(spark, path, "telemetry_readings", ["batch"])


def test_storage_policies(spark, feed, folder):
    feed.send(record(BASE, power=1.0), record(BASE, power=2.0), "{bad", record(BASE + 1, voltage=180))
    feed.send(record(BASE, power=3.0), record(BASE + DAY_MS, power=4.0))  # replay and a new one
    path, rejected, points = folder + "/t", folder + "/r", folder + "/p"
    sink = storage.telemetry_sink(path, rejected, storage.points_sink(points))
    run(storage.start_sink(feed.stream(spark), sink, folder + "/c", ONCE))
    rows = {(r["timestamp"], r["power"]) for r in stored(spark, path).collect()}
    assert rows == {(BASE, 1.0), (BASE + DAY_MS, 4.0)}
    reasons = sorted(r["reason"] for r in spark.read.parquet(rejected).collect())
    assert reasons == ["Invalid JSON", "voltage must be 0 (device off) or between 200 and 250"]
    assert spark.read.parquet(points).count() == 2  # duplicates skip the secondary sink
    feed.send(record(BASE, power=9.0), record(BASE + 5, power=5.0))  # restart from the checkpoint
    run(storage.start_sink(feed.stream(spark), sink, folder + "/c", ONCE))
    assert stored(spark, path).count() == 3


def test_secondary_failure_is_dropped_and_primary_failure_is_retried(spark, feed, folder):
    feed.send(record(BASE), record(BASE + 1))

    def broken(_):
        raise OSError("secondary store is down")

    path = folder + "/t"
    run(storage.start_sink(feed.stream(spark), storage.telemetry_sink(path, folder + "/r", broken), folder + "/c", ONCE))
    assert stored(spark, path).count() == 2

    feed.send(record(BASE + 2))
    state = {"fail": True}
    good = storage.telemetry_sink(path, folder + "/r")

    def flaky(frame, batch_id):
        good(frame, batch_id)
        if state.pop("fail", False):
            raise OSError("lost after the write")

    query = storage.start_sink(feed.stream(spark), flaky, folder + "/c", ONCE)
    with pytest.raises(Exception, match="lost after the write"):
        query.awaitTermination(300)
    run(storage.start_sink(feed.stream(spark), flaky, folder + "/c", ONCE))
    assert stored(spark, path).count() == 3  # the retried batch replaced its own rows


def test_a_new_checkpoint_does_not_overwrite(spark, feed, folder):
    path = folder + "/t"
    feed.send(record(BASE))
    sink = storage.telemetry_sink(path, folder + "/r")
    run(storage.start_sink(feed.stream(spark), sink, folder + "/c1", ONCE))
    feed.send(record(BASE + 1))
    run(storage.start_sink(feed.stream(spark), sink, folder + "/c2", ONCE))
    assert stored(spark, path).count() == 2


def test_summaries_are_stored_once(spark, folder):
    frame = spark.createDataFrame(
        [("a", BASE, BASE + 2000, 1.0, 2.0, None, None, None, 3)],
        "node_id STRING, window_start BIGINT, window_end BIGINT, avg_power DOUBLE, max_power DOUBLE, "
        "avg_voltage DOUBLE, avg_current DOUBLE, avg_energy_wh DOUBLE, record_count INT",
    )
    sink = storage.summary_sink(folder + "/s")
    sink(frame, 1)
    sink(frame, 1)
    sink(frame.withColumn("avg_power", F.lit(9.0)), 2)
    rows = tables.read_days(spark, folder + "/s", "stream_summaries", ["batch"]).collect()
    assert [(r["avg_power"], r["record_count"]) for r in rows] == [(1.0, 3)]


def test_router(spark, feed, folder):
    event = json.dumps({"node_id": "n", "node_type": "m", "timestamp": BASE, "event_type": "alarm",
                        "severity": "high", "message": "x", "buffered": True})
    health = json.dumps({"node_id": "n", "node_type": "m", "timestamp": BASE, "sequence_no": 4,
                         "status": "online", "uptime_sec": 5, "mqtt_connected": True,
                         "wifi_connected": True, "sensor_ok": False, "buffered_count": 0})
    feed.send(record(BASE), record(BASE, power=-1), "{bad")
    feed.send(event, "{bad", topic="energy/nodes/n/events")
    feed.send(health, topic="energy/nodes/n/health")
    feed.send(health, topic="energy/other")
    telemetry = storage.telemetry_sink(folder + "/t", folder + "/r")
    sink = storage.router_sink(telemetry, folder + "/e", folder + "/h")
    run(storage.start_sink(feed.stream(spark), sink, folder + "/c", ONCE))
    assert stored(spark, folder + "/t").count() == 1
    events = tables.read_days(spark, folder + "/e", "node_events", ["batch"]).collect()
    assert [(r["event_type"], r["buffered"], r["timestamp"]) for r in events] == [("alarm", True, BASE)]
    beats = tables.read_days(spark, folder + "/h", "node_health", ["batch"]).collect()
    assert [(r["sequence_no"], r["sensor_ok"]) for r in beats] == [(4, False)]


def test_live_feed_needs_all_fields(spark):
    full = json.dumps({f: 1 for f in windows.SUMMARY_FIELDS})
    frame = spark.createDataFrame([(full,), ('{"node_id": 1}',), ("{bad",)], "value STRING")
    assert windows.live_feed(frame).count() == 1


def test_scoring_gate_bootstrap_and_results(spark, feed, folder):
    now = BASE + 38 * DAY_MS  # a Monday
    # Stored daytime history of one old node, enough to train on.
    history = spark.range(31 * 14).selectExpr(
        "'old' AS node_id",
        f"{BASE - BASE % DAY_MS} + (id DIV 14) * {DAY_MS} + (8 + id % 14) * {HOUR_MS} AS timestamp",
        "230D AS voltage", "1D AS current", "60D AS power", "5D AS energy_wh",
        "timestamp_millis(0) AS created_at",
    )
    telemetry = folder + "/t"
    tables.replace_days(
        tables.with_day(history).withColumn("batch", F.lit("h")), telemetry, ["event_date", "batch"]
    )
    scoring.update_first_seen(history, folder + "/seen")
    night = now - now % DAY_MS + 3 * HOUR_MS
    sent = []
    sink = scoring.scoring_sink(
        folder + "/m", folder + "/seen", telemetry, folder + "/a",
        send=lambda frame: sent.extend(frame.collect()), clock=lambda: now, contamination=0.05,
    )
    feed.send(record(night, "old"), record(night, "new"), record(night + 11 * HOUR_MS, "old"), "{bad")
    run(storage.start_sink(feed.stream(spark), sink, folder + "/c", ONCE))
    rows = tables.read_days(spark, folder + "/a", "anomaly_records", ["batch"]).collect()
    assert [(r["node_id"], r["timestamp"]) for r in rows] == [("old", night)]
    assert rows[0]["anomaly_type"] == "unusual_time_window_usage" and rows[0]["severity"] != "normal"
    assert [(r["node_id"], r["anomaly_score"]) for r in sent] == [("old", rows[0]["score"])]
    seen = {r[0]: r[1] for r in scoring.read_first_seen(spark, folder + "/seen").collect()}
    assert seen["new"] == night and seen["old"] < BASE + DAY_MS


def test_scoring_waits_without_enough_history(spark, feed, folder):
    clock = {"now": BASE}
    sink = scoring.scoring_sink(
        folder + "/m", folder + "/seen", folder + "/t", folder + "/a", clock=lambda: clock["now"]
    )
    feed.send(record(BASE - 31 * DAY_MS, "old"))
    run(storage.start_sink(feed.stream(spark), sink, folder + "/c", ONCE))
    assert tables.read_days(spark, folder + "/a", "anomaly_records", ["batch"]).count() == 0
    assert scoring.read_first_seen(spark, folder + "/seen").count() == 1


def test_first_seen_stores_only_changes(spark, folder):
    def batch(ms):
        rows = spark.createDataFrame([("a", ms)], "node_id STRING, timestamp BIGINT")
        return scoring.update_first_seen(rows, folder + "/s").first()["first_seen_ms"]

    assert batch(10) == 10
    assert batch(20) == 10
    assert batch(5) == 5
    assert batch(5) == 5  # retried
    assert spark.read.parquet(folder + "/s").count() == 2
    scoring.compact_first_seen(spark, folder + "/s")
    assert spark.read.parquet(folder + "/s").count() == 1
    assert batch(7) == 5 and batch(3) == 3


def one_batch(spark, rows):
    schema = "topic STRING, value STRING, seq STRUCT<topic: STRING, partition: INT, offset: BIGINT>"
    return spark.createDataFrame([(t, v, (t, p, o)) for t, v, p, o in rows], schema)


def files_of(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


def test_many_batches_keep_few_files(spark, folder, monkeypatch):
    monkeypatch.setattr(storage, "TIDY_EVERY", 6)
    points = storage.points_sink(folder + "/p")
    sink = storage.telemetry_sink(folder + "/t", folder + "/r", points)
    for i in range(40):
        rows = [("t", record(BASE + 1000 * i, power=float(i)), 0, 2 * i), ("t", "{bad", 0, 2 * i + 1)]
        sink(one_batch(spark, rows), i)
    for path in "tpr":
        assert files_of(f"{folder}/{path}") <= 6 + 3 + 1
    assert stored(spark, folder + "/t").count() == 40
    assert spark.read.parquet(folder + "/p").count() == 40
    assert spark.read.parquet(folder + "/r").count() == 40


def test_a_batch_delivered_twice_is_stored_once(spark, folder):
    sink = storage.telemetry_sink(folder + "/t", folder + "/r", storage.points_sink(folder + "/p"))
    health = json.dumps({"node_id": "n", "timestamp": BASE, "sequence_no": 4})
    dateless = json.dumps({"node_id": "n", "sequence_no": 5})
    router = storage.router_sink(sink, folder + "/e", folder + "/h")
    topic, beat = "energy/nodes/n/telemetry", "energy/nodes/n/health"
    rows = [(topic, record(), 0, 1), (topic, record(BASE + DAY_MS), 0, 2),
            (beat, health, 0, 1), (beat, dateless, 0, 2)]
    for _ in range(2):
        router(one_batch(spark, rows), 7)
        sink(one_batch(spark, [(topic, "{bad", 0, 3), (topic, record(), 0, 4)]), 8)
    router(one_batch(spark, rows[2:3]), 9)  # another batch: a record of its own
    assert stored(spark, folder + "/t").count() == 2
    assert spark.read.parquet(folder + "/p").count() == 2
    assert spark.read.parquet(folder + "/r").count() == 1
    assert spark.read.parquet(folder + "/h").count() == 3


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_equal_offsets_of_two_topics_have_one_winner(spark, folder, parts):
    rows = [(t, record(BASE + i, power=p), part, i) for i in range(20)
            for t, p, part in (("b", 2.0, 0), ("a", 1.0, 1), ("a", 3.0, 5000))]
    sink = storage.telemetry_sink(folder + "/t", folder + "/r")
    sink(one_batch(spark, rows).repartition(parts), 0)
    assert {r["power"] for r in stored(spark, folder + "/t").collect()} == {1.0}


def test_a_batch_over_many_days_finds_what_is_stored(spark, folder):
    sink = storage.telemetry_sink(folder + "/t", folder + "/r")
    days = [("t", record(BASE - i * DAY_MS), 0, i) for i in range(130)]
    sink(one_batch(spark, days[:70]), 0)
    sink(one_batch(spark, days), 1)
    assert stored(spark, folder + "/t").count() == 130
