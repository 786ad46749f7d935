"""Queries: rollups, statistics, windows, ranked reads and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import forecasting, keyed, nodes, quality, ranked, recommend
from ..operators import rollups, runs, scaling, sequences
from ..schemas import READING_FIELDS
from ..streaming.windows import summarise
from .registry import query, r9, r9_sql
from .standins import FEB_01, JAN_16, JAN_29, JAN_30, JAN_31, Views

ROLLUP = ["total_consumption_wh", "avg_power_w", "peak_power_w"]
HOURLY = [
    "avg_power", "avg_voltage", "avg_current", "min_power", "max_power", "std_power",
    "avg_energy_wh",
]
DAY_TEXT = "strftime(make_timestamp(day * 86400000000), '%Y-%m-%d')"


@query("d1_hourly_rollup", f"""
SELECT node_id, division, hour_ms, {r9_sql(*ROLLUP)}, reading_count FROM hourly_rollup""")
def d1(v: Views):
    hourly = rollups.hourly_rollup(v.telemetry, v.metadata)
    return hourly.select("node_id", "division", "hour_ms", *r9(*ROLLUP), "reading_count")


@query("d2_daily_rollup", f"""
SELECT node_id, division, {DAY_TEXT} AS date, {r9_sql(*ROLLUP)},
       CAST(reading_count AS BIGINT) AS reading_count FROM daily_rollup""")
def _(v: Views):
    daily = rollups.daily_rollup(v.telemetry, v.metadata)
    return daily.select(
        "node_id", "division", F.col("date").cast("string").alias("date"),
        *r9(*ROLLUP), "reading_count",
    )


@query("d3_hourly_features", f"""
SELECT node_id, timestamp, {r9_sql(*HOURLY)}, CAST(reading_count AS INTEGER) AS reading_count
FROM hourly""")
def _(v: Views):
    return v.hourly.select("node_id", "timestamp", *r9(*HOURLY), "reading_count")


@query("d4_first_seen",
       "SELECT node_id, min(timestamp) AS first_seen_ms FROM telemetry GROUP BY 1")
def _(v: Views):
    return nodes.first_seen(v.telemetry)


STATUS_SQL = f"""
SELECT node_id, days < 30 AS learning_mode, first_seen_ms, round(days, 1) AS days_since_first_seen,
       CASE WHEN days < 30 THEN round(greatest(0.0, 30 - days), 1) ELSE 0.0 END AS days_remaining
FROM (SELECT node_id, min(timestamp) AS first_seen_ms,
             ({FEB_01} - min(timestamp)) / CAST(86400000 AS DOUBLE) AS days
      FROM telemetry GROUP BY 1)"""


@query("d5_status_of_node", STATUS_SQL + " WHERE node_id = 'node_7'")
def _(v: Views):
    return nodes.status_of_node(v.telemetry, "node_7", FEB_01)


@query("d6_node_status", STATUS_SQL)
def _(v: Views):
    return nodes.node_status(nodes.first_seen(v.telemetry), FEB_01)


@query("d7_detector_readiness", """
SELECT min(timestamp) AS min_ms, max(timestamp) AS max_ms, CAST(count(*) AS BIGINT) AS readings,
       round((max(timestamp) - min(timestamp)) / CAST(86400000 AS DOUBLE), 9) AS span_days,
       (max(timestamp) - min(timestamp)) / CAST(86400000 AS DOUBLE) >= 30
         AND count(*) >= 100 AS ready FROM telemetry""")
def _(v: Views):
    return nodes.detector_readiness(v.telemetry).withColumn("span_days", F.round("span_days", 9))


@query("d8_forecaster_readiness", """
SELECT CAST(sum(n) AS BIGINT) AS rows,
       round((max(b) - min(a)) / CAST(86400000 AS DOUBLE), 9) AS span_days,
       CAST(count(*) FILTER (n >= 34) AS BIGINT) AS long_nodes,
       (max(b) - min(a)) / CAST(86400000 AS DOUBLE) >= 30 AND max(n) >= 34 AS ready
FROM (SELECT node_id, count(*) AS n, min(timestamp) AS a, max(timestamp) AS b
      FROM hourly WHERE avg_power IS NOT NULL GROUP BY 1)""")
def _(v: Views):
    return nodes.forecaster_readiness(v.hourly).withColumn("span_days", F.round("span_days", 9))


@query("d9_pooled_quantile", """
SELECT round(quantile_cont(predicted_consumption, 0.9), 9) AS quantile FROM forecasts""")
def _(v: Views):
    return ranked.exact_quantile(v.forecasts, "predicted_consumption", 0.9).select(*r9("quantile"))


@query("d10_peak_hours", f"""
WITH f AS (SELECT * FROM forecasts WHERE timestamp >= {JAN_30} AND timestamp < {JAN_31})
SELECT node_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS peak_hours, max(p) AS peak
FROM (SELECT node_id, timestamp // 3600000 % 24 AS h, max(predicted_consumption) AS p FROM f
      WHERE predicted_consumption >= (SELECT quantile_cont(predicted_consumption, 0.9) FROM f)
      GROUP BY 1, 2) GROUP BY 1""")
def _(v: Views):
    peaks = recommend.peak_hours(recommend.upcoming_forecasts(v.forecasts, JAN_30))
    return peaks.withColumn("peak_hours", F.array_join("peak_hours", ","))


WORST_SQL = """
SELECT node_id, score, timestamp, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score, timestamp) AS rn
  FROM anomalies WHERE severity IN ('high', 'medium')) WHERE rn = 1"""


@query("d11_worst_anomaly", WORST_SQL)
def _(v: Views):
    return recommend.worst_anomalies(v.anomalies)


@query("d12_peak_forecast", """
SELECT node_id, max(predicted_consumption) AS peak FROM forecasts
WHERE predicted_consumption >= 800 GROUP BY 1""")
def _(v: Views):
    return recommend.peak_per_node(v.forecasts)


@query("d13_scoring_metrics", """
SELECT CAST(count(*) AS BIGINT) AS n_readings,
       CAST(count(*) FILTER (severity <> 'normal') AS BIGINT) AS n_anomalies,
       round(count(*) FILTER (severity <> 'normal') / CAST(count(*) AS DOUBLE), 4) AS anomaly_rate,
       round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score,
       round(max(score), 6) AS max_score FROM anomalies""")
def _(v: Views):
    return runs.scoring_metrics(v.anomalies.withColumnRenamed("score", "anomaly_score"))


REASON_SQL = """
CASE WHEN NOT timestamp BETWEEN 1000000000000 AND 9999999999999
       THEN 'Validation failed for ''timestamp'': expect_column_values_to_be_between'
     WHEN NOT voltage BETWEEN 0 AND 250
       THEN 'Validation failed for ''voltage'': expect_column_values_to_be_between'
     WHEN current < 0 THEN 'Validation failed for ''current'': expect_column_values_to_be_between'
     WHEN power < 0 THEN 'Validation failed for ''power'': expect_column_values_to_be_between'
     WHEN energy_wh < 0
       THEN 'Validation failed for ''energy_wh'': expect_column_values_to_be_between' END"""


@query("d14_validation_summary", f"""
SELECT '2024-01-16' AS start_time, '2024-01-29' AS end_time, CAST(count(*) AS BIGINT) AS checked,
       CAST(count(*) - count(reason) AS BIGINT) AS passed, CAST(count(reason) AS BIGINT) AS failed
FROM (SELECT {REASON_SQL} AS reason FROM telemetry
      WHERE created_ms >= {JAN_16} AND created_ms < {JAN_29})""")
def _(v: Views):
    start, end = (F.timestamp_millis(F.lit(ms)) for ms in (JAN_16, JAN_29))
    interval = quality.arrival_interval(v.telemetry, start, end).select(*READING_FIELDS)
    return quality.validation_summary(interval, "2024-01-16", "2024-01-29")


@query("d14_validation_failures", f"""
SELECT node_id, timestamp, reason FROM (SELECT *, {REASON_SQL} AS reason FROM telemetry)
WHERE reason IS NOT NULL""")
def _(v: Views):
    return quality.failures(v.telemetry.select(*READING_FIELDS))


@query("d15_feature_quality", """
SELECT CAST(count(*) AS BIGINT) AS row_count,
       CAST(count(*) - count(timestamp) AS BIGINT) AS null_timestamp,
       CAST(count(*) - count(avg_power) AS BIGINT) AS null_avg_power,
       CAST(count(*) - count(hour) AS BIGINT) AS null_hour,
       CAST(count(*) - count(day_of_week) AS BIGINT) AS null_day_of_week,
       CAST(count(*) FILTER (avg_power < 0) AS BIGINT) AS negative_power
FROM (SELECT timestamp, avg_power, timestamp // 3600000 % 24 AS hour,
             (timestamp // 86400000 + 4) % 7 + 1 AS day_of_week
      FROM (SELECT CASE WHEN reading_count % 5 <> 0 THEN timestamp END AS timestamp, avg_power
            FROM gappy))""")
def _(v: Views):
    some = F.when(F.col("reading_count") % 5 != 0, F.col("timestamp"))
    return feat.feature_quality(feat.with_calendar(v.gappy.withColumn("timestamp", some)))


@query("d16_reduction", """
SELECT CAST(a AS BIGINT) AS original_count, CAST(b AS BIGINT) AS hourly_count,
       a / CAST(b AS DOUBLE) AS reduction_ratio
FROM (SELECT (SELECT count(*) FROM dense) AS a, (SELECT count(*) FROM hourly) AS b)""")
def _(v: Views):
    return rollups.reduction(v.dense, v.hourly)


@query("d17_entity_count",
       "SELECT CAST(count(DISTINCT node_id) AS BIGINT) AS entities FROM telemetry")
def _(v: Views):
    return keyed.entity_count(v.telemetry)


@query("d18_node_integrity", """
SELECT node_id, CAST(count(*) AS BIGINT) AS total,
       CAST(count(DISTINCT timestamp) AS BIGINT) AS distinct_timestamps FROM deliveries
GROUP BY 1""")
def _(v: Views):
    return keyed.node_integrity(v.deliveries)


@query("d19_hourly_mean", """
SELECT node_id, timestamp // 3600000 * 3600000 AS timestamp, round(avg(power), 9) AS power_w
FROM telemetry GROUP BY 1, 2 HAVING avg(power) IS NOT NULL""")
def _(v: Views):
    readings = v.telemetry.withColumnsRenamed({"power": "power_w", "timestamp": "timestamp_ms"})
    return rollups.hourly_mean(readings).withColumn("power_w", F.round("power_w", 9))


@query("d20_sequence_count", """
SELECT CAST(sum(greatest(0, n - 33)) AS BIGINT) AS n_sequences
FROM (SELECT count(*) AS n FROM hourly GROUP BY node_id)""")
def _(v: Views):
    return sequences.sequence_count(v.hourly)


@query("d20_sequences_of_gappy_hours", """
SELECT CAST(sum(greatest(0, n - 33)) AS BIGINT) AS n_sequences
FROM (SELECT count(avg_power) AS n FROM gappy GROUP BY node_id)""")
def _(v: Views):
    return sequences.sequence_count(v.gappy)


@query("d21_min_max_fit", """
SELECT round(min(list_min(w)), 9) AS low, round(max(list_max(w)), 9) AS high FROM windows
WHERE rn % 2 = 1""")
def _(v: Views):
    fitted = scaling.fit_min_max(sequences.sliding_windows(v.hourly, stride=2))
    return fitted.select(*r9("low", "high"))


SCALED = ["hour_of_day", "day_of_week", "is_active"]
CELL_SQL = """
SELECT event_id, node_id, CAST(timestamp // 3600000 % 24 AS INTEGER) AS hour_of_day,
       CAST((timestamp // 86400000 + 3) % 7 AS INTEGER) AS day_of_week,
       CAST(CASE WHEN power > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_active FROM telemetry"""


@query("d22_standard_fit", "SELECT " + ", ".join(
    f"round(avg({c}), 9) AS mean_{c}, round(stddev_pop({c}), 9) AS scale_{c}" for c in SCALED
) + f" FROM ({CELL_SQL})")
def _(v: Views):
    fitted = scaling.fit_standard(scaling.detector_features(v.telemetry))
    return fitted.select(*r9(*fitted.columns))


@query("d23_forecast_errors", """
WITH s AS (SELECT min(list_min(w)) AS low, max(list_max(w)) AS high FROM windows),
pairs AS (SELECT (unnest(w[11:34]) - low) / (high - low) AS t, (list_avg(w[1:10]) - low) / (high - low) AS p
          FROM windows, s)
SELECT round(sqrt(avg((p - t) ** 2)), 9) AS test_rmse,
       round(avg(abs((t - p) / (abs(t) + 1e-8))), 6) AS test_mape FROM pairs""")
def _(v: Views):
    windows = sequences.sliding_windows(v.hourly)
    evaluated = forecasting.predict_normalised(
        windows, forecasting.mean_model(v.spark), scaling.fit_min_max(windows)
    )
    errors = forecasting.forecast_errors(evaluated)
    return errors.select(F.round("test_rmse", 9).alias("test_rmse"), F.round("test_mape", 6).alias("test_mape"))


@query("d24_anomalies_per_node", """
SELECT node_id, CAST(count(*) AS BIGINT) AS anomaly_count FROM anomalies
WHERE severity <> 'normal' GROUP BY 1""")
def _(v: Views):
    return rollups.anomalies_per_node(v.anomalies.where("severity <> 'normal'"))


@query("d24_severity_per_day", """
SELECT strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS date, severity,
       CAST(count(*) AS BIGINT) AS anomaly_count FROM anomalies GROUP BY 1, 2""")
def _(v: Views):
    counts = rollups.severity_per_day(v.anomalies)
    return counts.withColumn("date", F.col("date").cast("string"))


@query("d25_interval_summary", """
SELECT node_id, round(sum(avg_power * record_count) / sum(record_count), 9) AS avg_power,
       max(max_power) AS peak_power, CAST(sum(record_count) AS BIGINT) AS record_count
FROM summaries GROUP BY 1""")
def _(v: Views):
    out = rollups.interval_summary(summarise(v.dense))
    return out.withColumn("avg_power", F.round("avg_power", 9))


LAG_SQL = ", ".join(
    f"round(lag(avg_power, {n}) OVER (PARTITION BY node_id ORDER BY timestamp), 9) AS {name}"
    for name, n in feat.LAG_ROWS.items()
)


@query("e1_row_lags", f"SELECT node_id, timestamp, {LAG_SQL} FROM hourly")
def _(v: Views):
    return feat.with_lags(v.hourly).select("node_id", "timestamp", *r9(*feat.LAG_ROWS))


def _frame(days: int) -> str:
    return (
        "OVER (PARTITION BY node_id ORDER BY timestamp "
        f"RANGE BETWEEN {days * 86400000} PRECEDING AND CURRENT ROW)"
    )


ROLLING_SQL = {
    name: f"avg(avg_power) {_frame(days)}" for name, days in feat.ROLLING_DAYS.items()
}
DAY_STATS_SQL = {
    "rolling_min_24h": f"min(min_power) {_frame(1)}",
    "rolling_max_24h": f"max(max_power) {_frame(1)}",
    "rolling_std_24h": f"stddev_samp(avg_power) {_frame(1)}",
}


def rounded(columns: dict[str, str], digits: int = 8) -> str:
    return ", ".join(f"round({sql}, {digits}) AS {name}" for name, sql in columns.items())


@query("e2_rolling_averages",
       f"SELECT node_id, timestamp, {rounded(ROLLING_SQL)} FROM hourly")
def _(v: Views):
    rolled = feat.with_rolling(v.hourly)
    return rolled.select("node_id", "timestamp", *[F.round(c, 8).alias(c) for c in ROLLING_SQL])


@query("e3_rolling_day_statistics",
       f"SELECT node_id, timestamp, {rounded(DAY_STATS_SQL)} FROM hourly")
def _(v: Views):
    rolled = feat.with_rolling(v.hourly)
    return rolled.select(
        "node_id", "timestamp", *[F.round(c, 8).alias(c) for c in DAY_STATS_SQL]
    )


@query("e4_sliding_windows", """
SELECT node_id, start_ms, round(w[1], 9) AS x_first, round(w[10], 9) AS x_last,
       round(list_sum(w[1:10]), 9) AS x_sum, round(w[11], 9) AS y_first,
       round(list_sum(w[11:34]), 9) AS y_sum FROM windows WHERE rn % 2 = 1""")
def _(v: Views):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    windows = sequences.sliding_windows(v.hourly, stride=2)
    return windows.select(
        "node_id", "start_ms",
        F.round(F.col("x")[0], 9).alias("x_first"), F.round(F.col("x")[9], 9).alias("x_last"),
        F.round(total("x"), 9).alias("x_sum"), F.round(F.col("y")[0], 9).alias("y_first"),
        F.round(total("y"), 9).alias("y_sum"),
    )


@query("e4_windows_of_gappy_hours", """
WITH w AS (
  SELECT node_id, timestamp AS start_ms, list(avg_power) OVER (
    PARTITION BY node_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 33 FOLLOWING) AS w
  FROM gappy WHERE avg_power IS NOT NULL)
SELECT node_id, start_ms, round(w[1], 9) AS x_first, round(w[34], 9) AS y_last
FROM w WHERE len(w) = 34""")
def _(v: Views):
    return sequences.sliding_windows(v.gappy).select(
        "node_id", "start_ms", F.round(F.col("x")[0], 9).alias("x_first"),
        F.round(F.col("y")[23], 9).alias("y_last"),
    )


@query("e5_latest_inputs", """
SELECT node_id, string_agg(printf('%.9f', avg_power), ',' ORDER BY timestamp) AS x
FROM numbered WHERE n - rn < 10 GROUP BY node_id HAVING count(*) = 10""")
def _(v: Views):
    texts = F.transform("x", lambda x: F.format_string("%.9f", x))
    return sequences.latest_inputs(v.hourly).select("node_id", F.array_join(texts, ",").alias("x"))


@query("e6_time_split", """
SELECT node_id, timestamp, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
FROM numbered""")
def _(v: Views):
    return sequences.time_split(v.hourly).select("node_id", "timestamp", "split")


@query("e8_sequence_gaps", """
SELECT node_id, timestamp, previous, sequence_no, sequence_no - previous - 1 AS missing
FROM (SELECT *, lag(sequence_no) OVER (PARTITION BY node_id ORDER BY timestamp, sequence_no)
             AS previous FROM health) WHERE sequence_no - previous > 1""")
def _(v: Views):
    return keyed.sequence_gaps(v.health)


@query("f1_newest_first", """
SELECT node_id, timestamp, score FROM anomalies
ORDER BY timestamp DESC, node_id, score LIMIT 1000""")
def _(v: Views):
    rows = v.anomalies.select("node_id", "timestamp", "score")
    return ranked.newest(rows, "timestamp", 1000, ["node_id", "score"])


@query("f2_oldest_first", """
SELECT node_id, timestamp, predicted_consumption FROM forecasts
ORDER BY timestamp, node_id LIMIT 100""")
def _(v: Views):
    return ranked.oldest(v.forecasts, "timestamp", 100, ["node_id"])


@query("f3_multi_key_sort", """
SELECT node_id, timestamp, predicted_consumption FROM forecasts ORDER BY node_id, timestamp""")
def _(v: Views):
    return v.forecasts.orderBy("node_id", "timestamp")


@query("f4_oldest_rows", """
SELECT event_id, node_id, timestamp FROM telemetry ORDER BY timestamp, node_id LIMIT 5000""")
def _(v: Views):
    return ranked.oldest_rows(v.telemetry, 5000).select("event_id", "node_id", "timestamp")


@query("f5_best_runs", """
SELECT run_id, experiment, ts, test_mape AS metric FROM runs
WHERE experiment = 'load-forecasting' ORDER BY test_mape, ts, run_id LIMIT 10""")
def _(v: Views):
    return runs.best_runs(v.runs, "load-forecasting", "test_mape")


@query("f6_recent_runs", """
SELECT run_id, experiment, ts FROM runs WHERE experiment = 'anomaly-detection'
ORDER BY ts DESC, run_id LIMIT 10""")
def _(v: Views):
    return runs.recent_runs(v.runs, "anomaly-detection")


@query("g1_bag_union", """
SELECT event_id, node_id, power FROM telemetry UNION ALL SELECT event_id, node_id, power FROM dense""")
def _(v: Views):
    return (
        v.telemetry.select("event_id", "node_id", "power")
        .unionByName(v.dense.select("event_id", "node_id", "power"))
    )


@query("g2_rule_union", f"""
SELECT node_id, 'high_anomaly' AS type, count(*) AS n FROM ({WORST_SQL}) GROUP BY 1, 2
UNION ALL
SELECT node_id, 'high_consumption', CAST(1 AS BIGINT) FROM forecasts
WHERE predicted_consumption >= 800 GROUP BY 1""")
def _(v: Views):
    both = recommend.anomaly_rule(v.anomalies).unionByName(recommend.consumption_rule(v.forecasts))
    return both.groupBy("node_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("g3_split_union", "SELECT node_id, timestamp, round(avg_power, 9) AS avg_power FROM hourly")
def _(v: Views):
    split = sequences.time_split(v.hourly)
    whole = split.where("split = 'train'").unionByName(split.where("split = 'test'"))
    return whole.select("node_id", "timestamp", *r9("avg_power"))


@query("g4_first_write_wins", """
SELECT node_id, timestamp, power, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY node_id, timestamp ORDER BY seq) AS rn
  FROM deliveries) WHERE rn = 1""")
def _(v: Views):
    first = keyed.first_wins(v.deliveries, ["node_id", "timestamp"], "seq")
    return first.select("node_id", "timestamp", "power", "seq")


