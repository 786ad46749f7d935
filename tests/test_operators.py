import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.functions import numeric, timecols
from wattloom.functions.severity import severity
from wattloom.operators import features, forecasting, keyed, meters, nodes, quality, ranked
from wattloom.operators import recommend, retention, rollups, runs, scaling, sequences, serving
from wattloom.schemas import READING, TABLES, schema
from wattloom.streaming.windows import summarise

HOUR, DAY = timecols.HOUR_MS, timecols.DAY_MS
BASE = 1_704_067_200_000  # Monday 2024-01-01


def hourly(spark, counts, value=lambda node, i: float(i)):
    rows = [
        (node, BASE + i * HOUR, value(node, i)) for node, n in counts.items() for i in range(n)
    ]
    return spark.createDataFrame(rows, "node_id STRING, timestamp BIGINT, avg_power DOUBLE")


# --- order statistics -------------------------------------------------------


@pytest.mark.parametrize("n,accuracy", [(1, 50_000), (2, 50_000), (333, 50_000), (5000, 100), (5000, 1000)])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, n, accuracy, q):
    rng = random.Random(n * 7 + accuracy)
    data = [round(rng.lognormvariate(3, 2), 2) for _ in range(n)]
    frame = spark.createDataFrame([(x,) for x in data], "v DOUBLE").repartition(5)
    got = ranked.exact_quantile(frame, "v", q, accuracy).first()[0]
    assert got == pytest.approx(float(np.quantile(data, q)), rel=1e-12)


def test_exact_quantile_with_a_dominant_value(spark):
    """Two thirds of the rows share one value."""
    data = [7.0] * 6000 + [float(i) for i in range(3000)]
    frame = spark.createDataFrame([(x,) for x in data], "v DOUBLE").repartition(7)
    for q in (0.001, 0.1, 0.5, 0.9, 0.999):
        got = ranked.exact_quantile(frame, "v", q, accuracy=200).first()[0]
        assert got == pytest.approx(float(np.quantile(data, q)), rel=1e-12)


@pytest.mark.parametrize("kind", ["tail", "negative tail", "far ends", "neighbours"])
def test_exact_quantile_of_odd_spreads(spark, kind):
    rng = np.random.default_rng(5)
    data = {
        "tail": np.exp(8 * rng.normal(size=4000)),
        "negative tail": -np.exp(5 * rng.normal(size=2000)),
        "far ends": np.array([0.0] * 50 + [1e300, -1e300, 1.0]),
        "neighbours": 1 + np.arange(300) * 2.3e-16,
    }[kind]
    frame = spark.createDataFrame([(float(x),) for x in data], "v DOUBLE").repartition(3)
    for q in (0.5, 0.9, 0.999):
        got = ranked.exact_quantile(frame, "v", q, accuracy=1000).first()[0]
        assert got == pytest.approx(float(np.quantile(data, q)), rel=1e-12)


def test_exact_quantile_of_nothing(spark):
    empty = spark.createDataFrame([], "v DOUBLE")
    assert ranked.exact_quantile(empty, "v", 0.9).first()[0] is None
    nulls = spark.createDataFrame([(None,), (2.0,)], "v DOUBLE")
    assert ranked.exact_quantile(nulls, "v", 0.9).first()[0] == 2.0


def test_sample_is_exact_and_partition_independent(spark):
    frame = spark.range(20_000).withColumnRenamed("id", "k")
    one = {r.k for r in ranked.reproducible_sample(frame.repartition(3), 700, ["k"]).collect()}
    two = {r.k for r in ranked.reproducible_sample(frame.repartition(11), 700, ["k"]).collect()}
    digest = lambda k: int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:15], 16)
    assert one == two == set(sorted(range(20_000), key=digest)[:700])
    assert ranked.reproducible_sample(spark.range(5), 700, ["id"]).count() == 5


@pytest.mark.parametrize("n", [1, 40, 250, 999, 1000, 5000])
def test_oldest_rows_match_a_sort(spark, n):
    rng = random.Random(n)
    rows = sorted((BASE + rng.randrange(0, 3 * HOUR, 900_000), f"n{i:04d}") for i in range(1000))
    frame = spark.createDataFrame(rows, "timestamp BIGINT, node_id STRING").repartition(6)
    assert [tuple(r) for r in ranked.oldest_rows(frame, n).collect()] == rows[:n]


def test_limits_are_checked(spark):
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            ranked.newest(spark.range(1), "id", bad, [])


# --- keyed ------------------------------------------------------------------


def test_first_wins_takes_whole_rows(spark):
    rows = [("a", 1, 10.0, "x", 2), ("a", 1, 20.0, None, 1), ("a", 2, 5.0, "z", 9)]
    frame = spark.createDataFrame(rows, "node_id STRING, timestamp BIGINT, p DOUBLE, t STRING, seq INT")
    got = {tuple(r) for r in keyed.first_wins(frame, ["node_id", "timestamp"], "seq").collect()}
    assert got == {("a", 1, 20.0, None, 1), ("a", 2, 5.0, "z", 9)}


def test_first_wins_with_one_hot_key(spark):
    hot = spark.range(30_000).selectExpr("'hot' AS node_id", "1L AS timestamp", "id AS v", "30000 - id AS seq")
    cold = spark.range(10).selectExpr("'n' || id AS node_id", "1L AS timestamp", "id AS v", "1L AS seq")
    got = keyed.first_wins(hot.unionByName(cold), ["node_id", "timestamp"], "seq")
    assert got.where("node_id = 'hot'").first()["v"] == 29_999
    assert got.count() == 11


def test_sequence_gaps_match_a_plain_window(spark):
    rng = random.Random(3)
    rows = []
    for node in ("a", "b"):
        ms, seq = BASE, 0
        for _ in range(400):
            ms += rng.choice([60_000, 60_000, 7 * HOUR])
            seq += rng.choice([1, 1, 1, 2, 5])
            rows.append((node, ms, seq))
    frame = spark.createDataFrame(rows, "node_id STRING, timestamp BIGINT, sequence_no INT")
    want, last = set(), {}
    for node, ms, seq in rows:
        if node in last and seq - last[node] > 1:
            want.add((node, ms, last[node], seq, seq - last[node] - 1))
        last[node] = seq
    assert {tuple(r) for r in keyed.sequence_gaps(frame).collect()} == want


def test_pivot_round_trip_keeps_nulls(spark):
    frame = spark.createDataFrame([("a", 1, 2.0, None)], "node_id STRING, timestamp BIGINT, voltage DOUBLE, power DOUBLE")
    tall = keyed.to_points(frame, ["voltage", "power"])
    assert tall.count() == 2
    assert keyed.field_pivot(tall, ["voltage", "power"]).first().asDict() == frame.first().asDict()


# --- features and sequences -------------------------------------------------


def test_lags_count_rows_not_hours(spark):
    frame = hourly(spark, {"a": 30}).where(F.col("timestamp") != BASE + 5 * HOUR)
    got = features.with_lags(frame).where(F.col("timestamp") == BASE + 6 * HOUR).first()
    assert got["lag_1h"] == 4.0
    assert got["lag_24h"] is None


def test_day_window_holds_both_ends(spark):
    frame = hourly(spark, {"a": 30}).withColumns({"min_power": F.col("avg_power"), "max_power": F.col("avg_power")})
    got = features.with_rolling(frame).where(F.col("timestamp") == BASE + 29 * HOUR).first()
    window = np.arange(5.0, 30.0)  # 25 rows
    assert got["rolling_avg_1d"] == pytest.approx(window.mean())
    assert got["rolling_min_24h"] == 5.0 and got["rolling_max_24h"] == 29.0
    assert got["rolling_std_24h"] == pytest.approx(window.std(ddof=1))


def test_single_reading_hour_has_no_deviation(spark):
    frame = spark.createDataFrame([("a", BASE, 230.0, 1.0, 100.0, 5.0)], READING)
    row = features.hourly_features(frame).first()
    assert row["std_power"] is None and row["reading_count"] == 1


def test_feature_table_has_declared_columns(spark):
    frame = spark.createDataFrame([("a", BASE, 230.0, 1.0, 100.0, 5.0)], READING)
    table = features.engineer_features(features.hourly_features(frame)).drop("feature_timestamp")
    declared = {f.name: f.dataType for f in schema("energy_features")}
    assert {f.name: f.dataType for f in table.schema} == declared


@pytest.mark.parametrize("stride", [1, 2])
def test_windows_match_brute_force(spark, stride):
    counts = {"a": 40, "b": 34, "c": 33}
    got = {
        (r.node_id, r.start_ms): (list(r.x), list(r.y))
        for r in sequences.sliding_windows(hourly(spark, counts), stride=stride).collect()
    }
    want = {}
    for node, n in counts.items():
        for i in range(0, n - 34 + 1, stride):
            want[(node, BASE + i * HOUR)] = (
                [float(k) for k in range(i, i + 10)], [float(k) for k in range(i + 10, i + 34)]
            )
    assert got == want
    total = sequences.sequence_count(hourly(spark, counts)).first()[0]
    assert total == 7 + 1 + 0


def test_latest_inputs_skip_short_nodes(spark):
    rows = sequences.latest_inputs(hourly(spark, {"a": 12, "b": 9})).collect()
    assert [(r.node_id, list(r.x)) for r in rows] == [("a", [float(i) for i in range(2, 12)])]


def test_time_split_floors(spark):
    split = sequences.time_split(hourly(spark, {"a": 7, "b": 1}))
    counts = {tuple(r)[:2]: r[2] for r in split.groupBy("node_id", "split").count().collect()}
    assert counts == {("a", "train"): 5, ("a", "test"): 2, ("b", "test"): 1}


def test_shuffle_is_reproducible(spark):
    windows = sequences.sliding_windows(hourly(spark, {"a": 60}))
    one = [r.start_ms for r in sequences.shuffled(windows.repartition(5)).collect()]
    two = [r.start_ms for r in sequences.shuffled(windows.repartition(2)).collect()]
    assert one == two and one != sorted(one)


# --- forecaster -------------------------------------------------------------


def test_linear_model_recovers_a_linear_series(spark):
    frame = hourly(spark, {"a": 200, "b": 150}, lambda node, i: (3.0 if node == "a" else 5.0) * i + 2)
    windows = sequences.sliding_windows(frame, stride=2).repartition(3)
    model, scaler = forecasting.fit_linear(windows)
    assert model.count() == 24
    as_of = BASE + 200 * HOUR
    out = forecasting.forecast(frame.where("node_id = 'a'"), model, scaler, as_of).orderBy("timestamp").collect()
    assert [r.timestamp for r in out] == [as_of + h * HOUR for h in range(24)]
    want = [3.0 * (200 + h) + 2 for h in range(24)]
    assert [r.predicted_consumption for r in out] == pytest.approx(want, rel=1e-6)
    errors = forecasting.forecast_errors(forecasting.predict_normalised(windows, model, scaler)).first()
    assert errors["test_rmse"] < 1e-6 and errors["test_mape"] < 1e-3


def test_model_and_errors_match_numpy(spark):
    """Brute force over every window of a small irregular fixture."""
    rng = random.Random(11)
    series = {"a": 90, "b": 60, "c": 20}
    values = {(n, i): rng.uniform(0, 500) for n, k in series.items() for i in range(k)}
    frame = hourly(spark, series, lambda node, i: values[(node, i)])
    windows = sequences.sliding_windows(frame).repartition(5)
    model, scaler = forecasting.fit_linear(windows)
    flat = np.array(
        [[values[(n, i + k)] for k in range(34)] for n, c in series.items() for i in range(c - 33)]
    )
    norm = (flat - flat.min()) / (flat.max() - flat.min())
    design = np.hstack([np.ones((len(norm), 1)), norm[:, :10]])
    want = np.linalg.lstsq(design, norm[:, 10:], rcond=None)[0]
    got = {r.horizon: [r.intercept, *r.weights] for r in model.collect()}
    for h in range(24):
        assert got[h] == pytest.approx(want[:, h].tolist(), abs=1e-8)
    guess = np.maximum(0.0, design @ want)
    errors = forecasting.forecast_errors(
        forecasting.predict_normalised(windows, model, scaler)
    ).first()
    truth = norm[:, 10:]
    assert errors["test_rmse"] == pytest.approx(np.sqrt(np.mean((guess - truth) ** 2)), rel=1e-9)
    mape = np.mean(np.abs((truth - guess) / (np.abs(truth) + 1e-8)))
    assert errors["test_mape"] == pytest.approx(mape, rel=1e-6)


def test_forecasts_are_not_negative(spark):
    frame = hourly(spark, {"a": 120}, lambda _, i: 100.0 - i)
    windows = sequences.sliding_windows(frame)
    model, scaler = forecasting.fit_linear(windows)
    out = forecasting.forecast(frame, model, scaler, BASE + 120 * HOUR)
    assert out.count() == 24
    assert out.where("predicted_consumption < 0").count() == 0


def test_no_windows_give_null_errors(spark):
    windows = sequences.sliding_windows(hourly(spark, {"a": 20}))
    scaler = scaling.fit_min_max(windows)
    scored = forecasting.predict_normalised(windows, forecasting.mean_model(spark), scaler)
    row = forecasting.forecast_errors(scored).first()
    assert row["test_rmse"] is None and row["test_mape"] is None
    assert [f.count() for f in forecasting.fit_linear(windows)] == [0, 0]


def test_min_max_round_trip_and_constant_series(spark):
    windows = sequences.sliding_windows(hourly(spark, {"a": 40}, lambda *_: 5.0))
    scaler = scaling.fit_min_max(windows)
    scaled = scaling.apply_min_max(windows, scaler, ["x"])
    assert set(scaled.first()["x"]) == {0.0}
    assert set(scaling.invert_min_max(scaled, scaler, ["x"]).first()["x"]) == {5.0}


def test_weighted_scaler_equals_plain_scaler(spark):
    readings = spark.range(500).select(
        F.lit("a").alias("node_id"),
        (F.lit(BASE) + F.col("id") * 5_000_000).alias("timestamp"),
        (F.col("id") % 3).cast("double").alias("power"),
    )
    frame = scaling.detector_features(readings)
    plain = scaling.fit_standard(frame).first().asDict()
    counts = frame.groupBy(*scaling.FEATURES).agg(F.count(F.lit(1)).alias("n"))
    weighted = scaling.fit_standard(counts, weight="n").first().asDict()
    assert weighted == pytest.approx(plain)
    flat = scaling.fit_standard(frame.withColumn("is_active", F.lit(1))).first()
    assert flat["scale_is_active"] == 1.0


# --- quality ----------------------------------------------------------------

GOOD = ("node_001", 1714496400000, 230.0, 2.5, 575.0, 10.5)


def readings(spark, *rows, ddl=READING):
    return spark.createDataFrame(list(rows), ddl)


def test_suite_has_twelve_rules():
    assert len(quality.suite()) == 12
    assert [c for c, _ in quality.suite()].count("voltage") == 2


def test_summary_cases(spark):
    def counts(*rows):
        row = quality.validation_summary(readings(spark, *rows), "s", "e").first()
        return row["checked"], row["passed"], row["failed"]

    assert counts() == (0, 0, 0)
    assert counts(GOOD, GOOD) == (2, 2, 0)
    bad = (*GOOD[:2], 251.0, *GOOD[3:])
    assert counts(GOOD, bad) == (2, 1, 1)
    first = quality.failures(readings(spark, GOOD, bad)).first()
    assert first["reason"] == "Validation failed for 'voltage': expect_column_values_to_be_between"


def test_table_failure_fails_every_row_only_when_no_row_rule_does(spark):
    ddl = READING.replace("node_id STRING", "node_id INT")
    assert quality.validation_summary(readings(spark, (1, *GOOD[1:]), ddl=ddl), "s", "e").first()["failed"] == 1
    mixed = readings(spark, (1, *GOOD[1:]), (2, GOOD[1], 999.0, *GOOD[3:]), ddl=ddl)
    assert [r["node_id"] for r in quality.failures(mixed).collect()] == [2]


def test_nulls_pass_the_range_rules(spark):
    row = readings(spark, ("n", None, None, None, None, None))
    assert quality.failures(row).count() == 0


# --- nodes ------------------------------------------------------------------


def test_node_status_cases(spark):
    now = BASE + 100 * DAY
    seen = spark.createDataFrame(
        [("new", now - 5 * DAY), ("old", now - 35 * DAY), ("edge", now - 30 * DAY), ("none", None)],
        "node_id STRING, first_seen_ms BIGINT",
    )
    got = {r["node_id"]: r for r in nodes.node_status(seen, now).collect()}
    assert got["new"]["learning_mode"] and got["new"]["days_remaining"] == 25.0
    assert not got["old"]["learning_mode"] and got["old"]["days_remaining"] == 0.0
    assert not got["edge"]["learning_mode"]
    assert got["none"]["learning_mode"] and got["none"]["days_remaining"] == 30.0


def test_unknown_node_has_no_row(spark):
    assert nodes.status_of_node(readings(spark, GOOD), "ghost", BASE).count() == 0


def test_first_seen_survives_retention(spark):
    known = nodes.first_seen(readings(spark, GOOD))
    later = readings(spark, (GOOD[0], GOOD[1] + 40 * DAY, *GOOD[2:]))
    assert nodes.merge_first_seen(known, later).first()["first_seen_ms"] == GOOD[1]


def test_readiness(spark):
    few = readings(spark, GOOD, (GOOD[0], GOOD[1] + 31 * DAY, *GOOD[2:]))
    assert not nodes.detector_readiness(few).first()["ready"]
    many = few.unionByName(
        spark.range(100).selectExpr("'n' AS node_id", f"{GOOD[1]} + id AS timestamp", "1D AS voltage", "1D AS current", "1D AS power", "1D AS energy_wh")
    )
    assert nodes.detector_readiness(many).first()["ready"]
    assert not nodes.detector_readiness(few.limit(0)).first()["ready"]
    assert nodes.forecaster_readiness(hourly(spark, {"a": 31 * 24})).first()["ready"]
    assert not nodes.forecaster_readiness(hourly(spark, {"a": 29 * 24})).first()["ready"]


# --- recommendations --------------------------------------------------------


def anomalies(spark, *rows):
    return spark.createDataFrame(list(rows), TABLES["anomaly_records"])


def forecasts(spark, *rows):
    return spark.createDataFrame(list(rows), TABLES["forecasts"])


NINE = 1_726_131_600_000  # 09:00 on a September day


def test_anomaly_rule_cases(spark):
    rows = anomalies(
        spark,
        ("oven", 7, "t", -0.2125, "high"), ("oven", 5, "t", -0.4375, "high"),
        ("oven", 9, "t", -0.4375, "medium"),
        ("pump", 3, "t", -0.0625, "medium"), ("lamp", 4, "t", -0.03125, "low"),
    )
    got = {r["node_id"]: r for r in recommend.anomaly_rule(rows).collect()}
    assert set(got) == {"oven", "pump"}
    assert got["oven"]["anomaly_score"] == -0.4375 and got["pump"]["severity"] == "medium"
    assert got["oven"]["message"] == (
        "Node oven flagged with high-severity anomaly (score -0.438). "
        "Inspect for irregular consumption."
    )
    assert json.loads(got["oven"]["metadata_json"]) == {"anomaly_score": -0.4375}


def test_consumption_rule_cases(spark):
    rows = forecasts(
        spark, ("oven", NINE, 1203.25), ("oven", NINE + HOUR, 811.0), ("pump", NINE, 799.75),
        ("edge", NINE, 800.0),
    )
    got = {r["node_id"]: r for r in recommend.consumption_rule(rows).collect()}
    assert set(got) == {"oven", "edge"}
    assert got["oven"]["message"] == (
        "Node oven forecast exceeds 800W (peak: 1203W). Review connected loads."
    )
    assert json.loads(got["oven"]["metadata_json"]) == {"max_consumption_watts": 1203.25}


def test_load_shift_lists_peak_hours(spark):
    watts = [40.0] * 18 + [310.0, 615.0]  # the last two hours, from 03:00 on, stand out
    rows = forecasts(spark, *[("pump", NINE + i * HOUR, w) for i, w in enumerate(watts)])
    row = recommend.load_shift_rule(rows).first()
    assert row["type"] == "load_shift" and row["severity"] == "medium"
    assert row["peak_hours"] == [3, 4]
    assert json.loads(row["metadata_json"]) == {"peak_hours": [3, 4], "max_consumption_watts": 615.0}
    assert "(615W)" in row["message"]


def test_high_consumption_suppresses_load_shift(spark):
    rows = forecasts(
        spark,
        *[("oven", NINE + i * HOUR, 820.0 + 7 * i) for i in range(6)],
        *[("pump", NINE + i * HOUR, 20.0 + 125 * i) for i in range(6)],
    )
    got = recommend.recommendations(anomalies(spark), rows, NINE).collect()
    assert [(r["node_id"], r["type"]) for r in got] == [("oven", "high_consumption")]


def test_overlapping_runs_count_once(spark):
    runs = [("oven", NINE, 1100.0, 1), ("oven", NINE, 90.0, 2), ("pump", NINE, 60.0, 1)]
    rows = spark.createDataFrame(runs, TABLES["forecasts"] + ", run_ts BIGINT")
    got = recommend.recommendations(anomalies(spark), rows, NINE).collect()
    assert "high_consumption" not in {r["type"] for r in got}
    records = serving.forecast_records(rows).collect()
    assert {(r["node_id"], r["predicted_consumption"]) for r in records} == {("oven", 90.0), ("pump", 60.0)}


def test_nothing_in_nothing_out(spark):
    assert recommend.recommendations(anomalies(spark), forecasts(spark), NINE).count() == 0


def test_time_windows_of_the_rules(spark):
    recent = recommend.recent_anomalies(
        anomalies(spark, ("in", NINE - 6 * HOUR, "t", -1.0, "high"), ("out", NINE - 6 * HOUR - 1, "t", -1.0, "high")), NINE
    )
    assert [r["node_id"] for r in recent.collect()] == ["in"]
    ahead = recommend.upcoming_forecasts(
        forecasts(spark, ("in", NINE, 1.0), ("out", NINE + 24 * HOUR, 1.0), ("old", NINE - 1, 1.0)), NINE
    )
    assert [r["node_id"] for r in ahead.collect()] == ["in"]


# --- serving, runs, retention, meters ----------------------------------------


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin"])
def test_day_first_texts_are_utc_in_any_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("10/3/2024", "2:30:00"), ("31/3/2024", "02:30:00"), ("1/1/2024", "x"), (None, "1:00:00")]
        frame = spark.createDataFrame(rows, "d STRING, t STRING")
        got = [r[0] for r in frame.select(timecols.day_first_to_ms("d", "t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [1_710_037_800_000, 1_711_852_200_000, None, None]


def test_node_id_pattern():
    serving.check_node_id("node-1_a")
    serving.check_node_id(None)
    with pytest.raises(ValueError):
        serving.check_node_id('x" or 1')


def test_history_fills_missing_values_and_excludes_the_end(spark):
    rows = readings(spark, ("a", NINE, None, 1.0, None, 2.0), ("a", NINE + 1000, 1.0, 1.0, 1.0, 1.0))
    got = serving.telemetry_history(rows, NINE, "a", NINE, NINE + 1000).collect()
    assert [tuple(r) for r in got] == [("a", NINE, 0.0, 1.0, 0.0, 2.0)]


def test_latest_forecast_run_wins(spark):
    rows = spark.createDataFrame(
        [("a", NINE, 1.0, 1), ("a", NINE, 2.0, 5), ("b", NINE, 3.0, 1)],
        "node_id STRING, timestamp BIGINT, predicted_consumption DOUBLE, run_ts BIGINT",
    )
    got = {r[0]: r[2] for r in serving.latest_forecasts(rows).collect()}
    assert got == {"a": 2.0, "b": 3.0}


def run_rows(spark, *rows):
    full = [(i, e, t, {}, {} if m is None else {"test_mape": m}) for i, e, t, m in rows]
    return spark.createDataFrame(full, TABLES["runs"])


@pytest.mark.parametrize(
    "metrics,promoted",
    [([0.2, 0.1], True), ([0.1, 0.2], False), ([0.1], False), ([0.1, 0.1], False),
     ([0.1, None], False), ([0.3, 0.2, 0.1], True), ([0.1, 0.3, 0.2], False), ([None, 0.1], False)],
)
def test_promotion(spark, metrics, promoted):
    rows = [(f"r{i}", "load-forecasting", i, m) for i, m in enumerate(metrics)]
    got = runs.promotions(run_rows(spark, *rows)).first()
    assert got["promoted"] is promoted and got["runs"] == len(metrics)
    assert got["run_id"] == f"r{len(metrics) - 1}"


def test_best_and_recent_runs(spark):
    rows = run_rows(spark, ("a", "x", 1, 0.5), ("b", "x", 2, 0.1), ("c", "x", 3, None), ("d", "y", 4, 0.0))
    assert [r.run_id for r in runs.best_runs(rows, "x", "test_mape").collect()] == ["b", "a", "c"]
    assert [r.run_id for r in runs.recent_runs(rows, "x", 2).collect()] == ["c", "b"]


def test_unknown_table_has_no_retention():
    with pytest.raises(ValueError):
        retention.expired("node_metadata", 0)


def test_severity_bands(spark):
    scores = [-0.2, -0.15, -0.1, -0.05, -0.01, 0.0, 0.01]
    frame = spark.createDataFrame([(s,) for s in scores], "s DOUBLE")
    got = [r[0] for r in frame.select(severity("s")).collect()]
    assert got == ["high", "high", "medium", "medium", "low", "low", "normal"]


def test_clip_keeps_null(spark):
    frame = spark.createDataFrame([(None,), (-1.0,), (5.0,)], "x DOUBLE")
    assert [r[0] for r in frame.select(numeric.clip("x", 0, 2)).collect()] == [None, 0.0, 2.0]
    texts = spark.createDataFrame([("1.5",), ("x",), ("NaN",)], "x STRING")
    assert [r[0] for r in texts.select(numeric.to_double("x")).collect()] == [1.5, None, None]


def test_daily_average_is_not_an_average_of_averages(spark):
    rows = readings(
        spark, ("a", BASE, 230.0, 1.0, 10.0, 1.0), ("a", BASE + HOUR, 230.0, 1.0, 40.0, 1.0),
        ("a", BASE + HOUR + 1, 230.0, 1.0, 40.0, 1.0), ("a", BASE + 2 * HOUR, 230.0, 1.0, None, 1.0),
    )
    meta = spark.createDataFrame([("b", "t", "north")], TABLES["node_metadata"])
    row = rollups.daily_rollup(rows, meta).first()
    assert row["avg_power_w"] == pytest.approx(30.0) and row["reading_count"] == 4
    assert row["division"] is None and row["total_consumption_wh"] == 4.0


def test_window_summary_arithmetic(spark):
    rows = readings(
        spark, ("a", NINE, 220.0, 1.0, 400.0, 10.0), ("a", NINE + 1000, 240.0, 3.0, 600.0, 20.0),
        ("a", NINE + 5000, 230.0, 1.0, 1.0, 1.0),
    )
    first = summarise(rows).orderBy("window_start").first()
    assert (first["window_start"], first["window_end"]) == (NINE, NINE + 2000)
    assert (first["avg_power"], first["max_power"], first["avg_voltage"]) == (500.0, 600.0, 230.0)
    assert (first["avg_current"], first["avg_energy_wh"], first["record_count"]) == (2.0, 15.0, 2)


def test_first_households_by_appearance(spark):
    rows = spark.createDataFrame(
        [("late", 5), ("early", 1), ("early", 9), ("mid", 3)], "node_id STRING, timestamp_ms BIGINT"
    )
    got = {r.node_id for r in meters.first_households(rows, 2).collect()}
    assert got == {"early", "mid"}
