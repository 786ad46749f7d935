import json
import os

import pytest
from pyspark.sql import functions as F

from wattloom.functions.timecols import DAY_MS, HOUR_MS
from wattloom.operators import meters, nodes, retention
from wattloom.plans import jobs
from wattloom.schemas import READING, TABLES
from wattloom.sources import files, jdbc, tables, topics

BASE = 1_704_067_200_000


def readings(spark, n, node="a", step=HOUR_MS, start=BASE):
    return spark.range(n).selectExpr(
        f"'{node}' AS node_id", f"{start} + id * {step} AS timestamp", "230D AS voltage",
        "1D AS current", "CAST(id % 24 AS DOUBLE) * 10 AS power", "2.5D AS energy_wh",
    )


def test_reading_array_file(spark, folder):
    records = [
        {"node_id": "plug_01", "timestamp": 1710000000000, "voltage": 229.8, "current": 1.2,
         "power": 275.8, "energy_wh": 1180.0},
        {"node_id": "plug_02", "timestamp": 1710000000000, "voltage": 231.4, "current": 0.9,
         "power": 208.3, "energy_wh": 842.0},
    ]
    with open(folder + "/readings.json", "w") as out:
        json.dump(records, out, indent=2)
    got = files.read_reading_array(spark, folder + "/readings.json").orderBy("node_id")
    assert [r.asDict() for r in got.collect()] == records


def test_quarter_hour_files_with_other_columns(spark, folder):
    names = list(meters.QUARTER_HOUR_COLUMNS)
    rows = {
        "one": [",".join(["extra", *names]),
                "x,h1,1704067200000,1.5,230,0,",
                "x,h1,bad,1.5,230,3,0.9",
                "x,h1,1704068100000,-0.5,230,500,2.0"],
        "two": [",".join(reversed(names)),
                ",".join(reversed(["h2", "1704067200000", "2", "199", "3", "0.9"])),
                ",".join(reversed(["h2", "1704067200000", "2", "n/a", "3", "0.9"])),
                ",".join(reversed(["h3", "1704067200000", "", "230", "3", "0.9"]))],
    }
    for name, lines in rows.items():
        with open(f"{folder}/{name}.csv", "w") as out:
            out.write("\n".join(lines) + "\n")
    raw = files.read_quarter_hour_csv(spark, [f"{folder}/one.csv", f"{folder}/two.csv"])
    got = meters.normalise_quarter_hour(raw).orderBy("timestamp_ms").collect()
    assert len(got) == 2
    first, second = got
    assert first["power_w"] == 1500.0 and first["energy_wh"] == 375.0
    assert first["power_factor"] == 0.85
    assert first["current"] == pytest.approx(1500.0 / (230 * 0.85))
    assert second["power_w"] == 0.0 and second["energy_wh"] == -125.0
    assert second["power_factor"] == 1.0 and second["current"] == 150.0


def test_minute_text_file(spark, folder):
    with open(folder + "/minute.txt", "w") as out:
        out.write(";".join(meters.MINUTE_COLUMNS[:3] + ["Global_reactive_power"] + meters.MINUTE_COLUMNS[3:]) + "\n")
        out.write("16/12/2006;17:24:00;4.216;0.418;234.840;18.400;0.000;1.000;17.000\n")
        out.write("28/4/2007;00:21:00;?;?;?;?;?;?;?\n")
    rows = meters.normalise_minute(files.read_minute_text(spark, folder + "/minute.txt")).collect()
    assert [tuple(r) for r in rows] == [
        ("uci-household-main", 1166289840000, 234.84, 18.4, 4216.0, 18.0)
    ]


def test_tables_replace_only_written_days(spark, folder):
    path = folder + "/t"
    tables.replace_days(tables.with_day(readings(spark, 48)), path)
    tables.replace_days(tables.with_day(readings(spark, 24).withColumn("power", F.lit(7.0))), path)
    stored = tables.read_days(spark, path, "telemetry_readings")
    assert stored.count() == 48
    assert stored.where("power = 7").count() == 24


def test_missing_table_reads_empty(spark, folder):
    stored = tables.read_days(spark, folder + "/none", "forecasts")
    assert stored.count() == 0 and "event_date" in stored.columns


def test_day_filter_prunes_partitions(spark, folder):
    from wattloom.operators.serving import telemetry_history

    path = folder + "/t"
    tables.replace_days(tables.with_day(readings(spark, 240)), path)
    stored = tables.read_days(spark, path, "telemetry_readings")
    query = telemetry_history(stored, BASE + 10 * DAY_MS, "a", BASE + DAY_MS, BASE + 2 * DAY_MS)
    assert query.count() == 24
    utils = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    plan = utils.explainString(query._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "GreaterThanOrEqual(timestamp,1704153600000)" in plan
    assert "EqualTo(node_id,a)" in plan


def test_purge_drops_days_and_rewrites_the_boundary(spark, folder):
    path = folder + "/t"
    rows = tables.with_day(readings(spark, 72)).withColumn(
        "batch", F.when(F.hour(F.timestamp_millis("timestamp")) < 6, "b1").otherwise("b2")
    )
    tables.replace_days(rows, path, ["event_date", "batch"])
    # Cutoff: the second day at 12:00, inside batch b2; b1 of that day is fully expired.
    as_of = BASE + DAY_MS + 12 * HOUR_MS + 30 * DAY_MS
    for _ in range(2):  # a repeated run changes nothing
        assert tables.purge_rows(spark, path, "telemetry_readings", as_of, 30) in (36, 0)
        left = spark.read.parquet(path)
        assert left.count() == 36
        assert left.agg(F.min("timestamp")).first()[0] == BASE + DAY_MS + 12 * HOUR_MS


def test_jdbc_options():
    base = jdbc.connection("jdbc:x:y", "telemetry_readings", "u", "p", "d")
    scan = jdbc.scan_options(base, "timestamp", 0, 100, 8)
    assert scan["numPartitions"] == "8" and scan["partitionColumn"] == "timestamp"
    assert scan["dbtable"] == "telemetry_readings"
    assert jdbc.overwrite_options(base)["truncate"] == "true"
    with pytest.raises(ValueError):
        jdbc.scan_options(base, "timestamp", 5, 1, 8)


def test_topic_options():
    assert topics.topic_options("k:9", "t")["startingOffsets"] == "earliest"
    assert topics.topic_options("k:9", "t", "latest")["startingOffsets"] == "latest"
    with pytest.raises(ValueError):
        topics.topic_options("k:9", "t", "middle")


def test_daily_run_is_repeatable(spark, folder):
    data = readings(spark, 100).unionByName(readings(spark, 50, "b"))
    meta = spark.createDataFrame([("a", "meter", "north")], TABLES["node_metadata"])
    for _ in range(2):
        report = jobs.daily_run(data, meta, folder + "/f", folder + "/h", folder + "/d").first()
    assert report["row_count"] == 150 and report["null_avg_power"] == 0
    hourly = spark.read.parquet(folder + "/h")
    daily = spark.read.parquet(folder + "/d")
    assert hourly.count() == 150 and daily.count() == 5 + 3
    assert hourly.where("node_id = 'a'").select("division").distinct().first()[0] == "north"
    assert hourly.where("node_id = 'b' AND division IS NOT NULL").count() == 0
    total = daily.agg(F.sum("total_consumption_wh"), F.sum("reading_count")).first()
    assert tuple(total) == (375.0, 150)


def test_incremental_features_equal_a_full_run(spark, folder):
    rng_power = "CAST(pmod(xxhash64(node_id, timestamp), 1000) AS DOUBLE) / 8"
    data = readings(spark, 40 * 24).unionByName(readings(spark, 300, "b", step=5 * HOUR_MS))
    data = data.withColumn("power", F.expr(rng_power)).where("timestamp % 7 <> 3")
    split = BASE + 33 * DAY_MS
    jobs.feature_job(data, folder + "/full")
    jobs.feature_job(data.where(F.col("timestamp") < split), folder + "/inc")
    jobs.feature_job(data, folder + "/inc", since_ms=split)
    drop = ["created_at"]
    full, inc = (spark.read.parquet(f"{folder}/{n}").drop(*drop) for n in ("full", "inc"))
    assert inc.count() == full.count()
    assert full.exceptAll(inc).count() == 0


def test_incremental_daily_run_equals_a_full_run(spark, folder):
    power = "CAST(pmod(xxhash64(node_id, timestamp), 1000) AS DOUBLE) / 8"
    data = readings(spark, 45 * 24).unionByName(readings(spark, 200, "b", step=5 * HOUR_MS))
    data = data.withColumn("power", F.expr(power))
    meta = spark.createDataFrame([("a", "meter", "north")], TABLES["node_metadata"])
    split = BASE + 43 * DAY_MS
    paths = lambda name: [f"{folder}/{name}_{t}" for t in "fhd"]
    jobs.daily_run(data, meta, *paths("full"))
    early = data.where(F.col("timestamp") < split + DAY_MS // 2)  # the last day is incomplete
    jobs.daily_run(early, meta, *paths("inc"))
    since = jobs.resume_ms(spark, paths("inc")[0])
    assert since == split
    before = {p: files_by_day(p) for p in paths("inc")}
    report = jobs.daily_run(data, meta, *paths("inc"), since).first()
    assert report["row_count"] == 2 * 24  # the rows written, not the table
    for one, two in zip(paths("full"), paths("inc")):
        full, inc = (spark.read.parquet(p).drop("created_at") for p in (one, two))
        assert inc.count() == full.count() and full.exceptAll(inc).count() == 0
        after = files_by_day(two)
        assert {d for d in after if after[d] != before[two].get(d)} == set(sorted(after)[-2:])


def files_by_day(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if "=" in d}


def test_history_reads_only_the_days_it_needs(spark, folder):
    data = readings(spark, 60 * 24)
    jobs.feature_job(data, folder + "/f")
    since = BASE + 59 * DAY_MS
    stored = tables.read_days(spark, folder + "/f", "energy_features")
    fresh = jobs.feat.hourly_features(data.where(F.col("timestamp") >= since))
    history = jobs._history(stored, fresh, since)
    assert history.count() == 30 * 24
    tenth = stored.where("timestamp % 36000000 = 0")  # too few in the frame: older rows come too
    before = tenth.where(F.col("timestamp") < since).count()
    assert 72 < before < 168 and jobs._history(tenth, fresh, since).count() == before
    fourth = stored.where("timestamp % 14400000 = 0")
    assert jobs._history(fourth, fresh, since).count() == 180


def test_retention_of_all_tables(spark, folder):
    now_day = F.expr(f"timestamp_millis({BASE} + CAST(timestamp - {BASE} AS BIGINT) * 2)")
    data = readings(spark, 72)
    meta = spark.createDataFrame([("a", "meter", "north")], TABLES["node_metadata"])
    names = ["telemetry_readings", "node_events", "node_health", "anomaly_records", "forecasts",
             "energy_features", "energy_analytics_hourly", "energy_analytics_daily"]
    paths = {n: f"{folder}/{n}" for n in names}
    for n in names[:3]:
        tables.replace_days(tables.with_day(data.withColumn("created_at", now_day)), paths[n])
    scores = data.select("node_id", "timestamp", F.lit("t").alias("anomaly_type"),
                         F.lit(-0.2).alias("score"), F.lit("high").alias("severity"))
    tables.replace_days(tables.with_day(scores), paths["anomaly_records"])
    jobs.daily_run(data, meta, *(paths[n] for n in names[5:]))
    forecasts = data.select("node_id", "timestamp", F.col("power").alias("predicted_consumption"))
    for run in (BASE, BASE + DAY_MS):
        tables.replace_days(forecasts.withColumn("run_ts", F.lit(run)), paths["forecasts"], ["run_ts"])
    frames = lambda: {n: spark.read.parquet(p) for n, p in paths.items()}
    as_of = BASE + DAY_MS + 12 * HOUR_MS + 30 * DAY_MS
    want = {n: f.count() - retention.kept(f, n, as_of).count() for n, f in frames().items()}
    assert want["telemetry_readings"] == 36 and want["forecasts"] == 72
    # Rows made a minute ago stay, however old the hours they are about.
    assert want["energy_features"] == want["energy_analytics_daily"] == 0
    for expected in (want, dict.fromkeys(names, 0)):
        got = {r["table_name"]: r["deleted"] for r in jobs.retention_job(spark, paths, as_of).collect()}
        assert got == {**expected, "total": sum(expected.values())}
        for n, f in frames().items():
            assert f.count() == retention.kept(f, n, as_of).count()
    # By creation time: of one day, half the rows are older than the limit.
    features = spark.read.parquet(paths["energy_features"])
    aged = features.withColumn("created_at", F.expr(f"timestamp_millis(timestamp - {DAY_MS})"))
    aged.write.partitionBy("event_date").parquet(folder + "/aged")
    assert tables.purge_rows(spark, folder + "/aged", "energy_features", as_of) == 60
    left = spark.read.parquet(folder + "/aged")
    assert left.count() == 12 and left.agg(F.min("timestamp")).first()[0] == BASE + 60 * HOUR_MS


def test_validation_gate(spark):
    data = readings(spark, 48).withColumn("created_at", F.timestamp_millis("timestamp"))
    ok = jobs.validation_gate(data, "2024-01-01 00:00:00", "2024-01-02 00:00:00").first()
    assert (ok["checked"], ok["failed"]) == (24, 0)
    bad = data.withColumn("voltage", F.lit(999.0))
    with pytest.raises(jobs.ValidationFailed):
        jobs.validation_gate(bad, "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    empty = jobs.validation_gate(bad, "2025-01-01 00:00:00", "2025-01-02 00:00:00").first()
    assert empty["checked"] == 0


def test_detector_training_run(spark, folder):
    data = readings(spark, 800)
    as_of = BASE + 800 * HOUR_MS
    run = jobs.retrain_detector(data, folder + "/m", "r1", as_of).first()
    assert run["experiment"] == "anomaly-detection"
    assert run["metrics"]["n_readings"] == 720
    assert 0 <= run["metrics"]["anomaly_rate"] <= 0.05
    assert run["params"]["n_estimators"] == "100"


def features_of(spark, hours, node="a"):
    return readings(spark, hours, node).select("node_id", "timestamp", F.col("power").alias("avg_power"))


def test_forecaster_training_run(spark):
    data = features_of(spark, 600).unionByName(features_of(spark, 300, "b"))
    model, scaler, run = jobs.retrain_forecaster(data, "r1", BASE + 600 * HOUR_MS)
    metrics = run.first()["metrics"]
    assert model.count() == 24 and scaler.count() == 1
    assert 0 <= metrics["test_rmse"] < 0.5
    with pytest.raises(ValueError):
        jobs.train_forecaster(features_of(spark, 20))


def test_forecast_job(spark, folder):
    early = jobs.forecast_job(features_of(spark, 100), BASE + 100 * HOUR_MS, folder + "/f").first()
    assert early["status"] == "not_enough_data"
    data = features_of(spark, 31 * 24)
    assert nodes.forecaster_readiness(data).first()["ready"]
    for shift in (0, 0, 1):  # the same run twice, then the next
        as_of = BASE + (31 * 24 + shift) * HOUR_MS
        done = jobs.forecast_job(data, as_of, folder + "/f").first()
        assert (done["status"], done["rows"]) == ("success", 24)
    stored = spark.read.parquet(folder + "/f")
    assert stored.count() == 48
    from wattloom.operators.serving import latest_forecasts

    assert latest_forecasts(stored).count() == 25


def test_snapshot_and_run_log(spark, folder):
    data = features_of(spark, 40 * 24)
    recent, _ = jobs.training_snapshot(data, readings(spark, 10), BASE + 40 * DAY_MS)
    for fmt in ("parquet", "csv"):
        files.export_snapshot(recent, f"{folder}/{fmt}", fmt)
        assert os.path.exists(f"{folder}/{fmt}/_SUCCESS")
    assert spark.read.parquet(folder + "/parquet").count() == 30 * 24
    run = jobs.runs.run_row(spark.range(1).select(F.lit(0.5).alias("test_mape")), "r", "x", 1, {})
    jobs.log_run(run, folder + "/runs")
    jobs.log_run(run, folder + "/runs")
    assert files.read_table(spark, folder + "/runs", "runs").count() == 2


def test_reading_schema_is_shared():
    assert TABLES["telemetry_readings"].startswith(READING)
