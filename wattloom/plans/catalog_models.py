"""Queries: data quality, window summaries, models, recommendations, retention, serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as msg
from ..operators import features as feat
from ..operators import forecasting, meters, nodes, quality, recommend, retention
from ..operators import isolation_forest as forest
from ..operators import rollups, runs, scaling, sequences, serving
from ..schemas import READING_FIELDS
from ..session import materialise
from ..streaming.scoring import ANOMALY_TYPE, anomalies_of
from ..streaming.windows import summarise
from .catalog_aggregates import (
    CELL_SQL, DAY_STATS_SQL, DAY_TEXT, HOURLY, LAG_SQL, REASON_SQL, ROLLING_SQL, ROLLUP, SCALED,
    rounded,
)
from .registry import query, r9, r9_sql
from .standins import FEB_01, JAN_16, JAN_30, JAN_31, SEVERITY_SQL, Views

FIELDS = ", ".join(READING_FIELDS)
NUMBER = "('UBIGINT', 'BIGINT', 'DOUBLE')"
PARSED = "SELECT *, try_cast(value AS JSON) AS j FROM messages"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _kind(field: str) -> str:
    return f"json_type(j, '$.{field}')"


def _number(field: str) -> str:
    return f"CAST(j ->> '$.{field}' AS DOUBLE)"


def _ingest_sql() -> str:
    cases = [
        ("j IS NULL", msg.BAD_JSON),
        (
            "list_sort(json_keys(j)) <> "
            "['current', 'energy_wh', 'node_id', 'power', 'timestamp', 'voltage']",
            msg.EXACT_FIELDS,
        ),
        (f"{_kind('node_id')} <> 'VARCHAR' OR trim(j ->> '$.node_id') = ''", msg.NODE_TEXT),
        (f"{_kind('timestamp')} NOT IN ('UBIGINT', 'BIGINT')", msg.MS_INTEGER),
        (f"{_number('timestamp')} NOT BETWEEN 1000000000000 AND 9999999999999", msg.MS_DIGITS),
        (f"{_kind('voltage')} NOT IN {NUMBER}", "voltage must be a number"),
        (
            f"NOT ({_number('voltage')} = 0 OR {_number('voltage')} BETWEEN 200 AND 250)",
            msg.VOLTAGE_RANGE,
        ),
    ]
    for field, text in msg.BELOW_ZERO.items():
        cases.append((f"{_kind(field)} NOT IN {NUMBER}", f"{field} must be a number"))
        cases.append((f"{_number(field)} < 0", text))
    whens = " ".join(f"WHEN {test} THEN {_quoted(text)}" for test, text in cases)
    return f"CASE {whens} END"


def _suite_sql() -> str:
    wrong = "expected correct type"
    cases = [
        ("trim(value) = ''", msg.EMPTY),
        ("j IS NULL", msg.BAD_JSON),
        (f"{_kind('node_id')} NOT IN ('VARCHAR', 'NULL')", msg.suite_text("node_id", wrong)),
        (
            f"{_kind('timestamp')} NOT IN ('UBIGINT', 'BIGINT', 'NULL')",
            msg.suite_text("timestamp", wrong),
        ),
        (f"{_kind('voltage')} IS NULL", msg.suite_text("voltage", msg.TYPE_LIST_RULE)),
        ("len(json_keys(j)) > 6", msg.suite_text("table", msg.TABLE_RULE)),
        (
            f"{_number('timestamp')} NOT BETWEEN 1000000000000 AND 9999999999999",
            msg.suite_text("timestamp", msg.RANGE_RULE),
        ),
    ]
    for field in ("voltage", "current", "power", "energy_wh"):
        outside = f"{_number(field)} < 0"
        if field == "voltage":
            outside += f" OR {_number(field)} > 250"
        cases.append(
            (
                f"{_kind(field)} NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL')",
                msg.suite_text(field, msg.TYPE_LIST_RULE),
            )
        )
        cases.append((outside, msg.suite_text(field, msg.RANGE_RULE)))
    whens = " ".join(f"WHEN {test} THEN {_quoted(text)}" for test, text in cases)
    return f"CASE {whens} ELSE {_quoted(msg.SUITE_OK)} END"


@query("h1_ingest_rules", f"SELECT event_id, {_ingest_sql()} AS reason FROM ({PARSED})")
def _(v: Views):
    return msg.judge_ingest(v.messages).select("event_id", "reason")


@query("h1_ingest_rules_typed", f"""
SELECT event_id, CASE
  WHEN NOT (voltage = 0 OR voltage BETWEEN 200 AND 250) THEN '{msg.VOLTAGE_RANGE}'
  WHEN current < 0 THEN 'current must be non-negative'
  WHEN power < 0 THEN 'power must be non-negative'
  WHEN energy_wh < 0 THEN 'energy_wh cannot be negative' END AS reason FROM telemetry""")
def _(v: Views):
    return v.telemetry.select("event_id", msg.ingest_reason_typed().alias("reason"))


@query("h2_envelope", f"""
SELECT event_id, CASE WHEN reason = '{msg.SUITE_OK}' THEN 'valid' ELSE 'invalid' END AS status, reason
FROM (SELECT event_id, {_suite_sql()} AS reason FROM ({PARSED}))""")
def _(v: Views):
    return msg.envelope(v.messages).select("event_id", "status", "reason")


def _expectations_sql() -> str:
    rows = []
    outside = {
        "timestamp": "NOT timestamp BETWEEN 1000000000000 AND 9999999999999",
        "voltage": "NOT voltage BETWEEN 0 AND 250",
    }
    for position, (column, rule) in enumerate(quality.suite(), start=1):
        count = "max(CAST(NULL AS BIGINT))"
        if rule == msg.RANGE_RULE:
            count = f"CAST(count(*) FILTER ({outside.get(column, column + ' < 0')}) AS BIGINT)"
        rows.append(
            f"SELECT {position} AS position, '{column}' AS column_name, '{rule}' AS expectation, "
            f"{count} AS unexpected FROM telemetry"
        )
    body = " UNION ALL ".join(rows)
    return f"SELECT *, coalesce(unexpected = 0, true) AS success FROM ({body})"


@query("h3_expectation_results", _expectations_sql())
def _(v: Views):
    return quality.expectation_results(v.telemetry.select(*READING_FIELDS))


@query("h4_record_verdicts", f"""
SELECT event_id, {_suite_sql()} AS reason FROM ({PARSED}) WHERE j IS NOT NULL""")
def _(v: Views):
    judged = msg.envelope(v.messages)
    return judged.where(~F.col("reason").isin(msg.EMPTY, msg.BAD_JSON)).select("event_id", "reason")


@query("h5_row_verdicts", f"SELECT node_id, timestamp, {REASON_SQL} AS reason FROM telemetry")
def _(v: Views):
    verdicts = quality.with_verdict(v.telemetry.select(*READING_FIELDS))
    return verdicts.select("node_id", "timestamp", "reason")


@query("h5_table_failure", """
SELECT node_id, timestamp, 'Telemetry validation failed' AS reason FROM telemetry""")
def _(v: Views):
    partial = v.telemetry.select("node_id", "timestamp", "energy_wh")
    return quality.with_verdict(partial).select("node_id", "timestamp", "reason")


@query("h7_failure_counts", f"""
SELECT reason, CAST(count(*) AS BIGINT) AS failed
FROM (SELECT {REASON_SQL} AS reason FROM telemetry) WHERE reason IS NOT NULL GROUP BY 1""")
def _(v: Views):
    return quality.failure_counts(v.telemetry.select(*READING_FIELDS))


SUMMARY = ["avg_power", "max_power", "avg_voltage", "avg_current", "avg_energy_wh"]


@query("i4_window_summaries", f"""
SELECT window_start, window_end, node_id, {r9_sql(*SUMMARY)},
       CAST(record_count AS INTEGER) AS record_count FROM summaries""")
def _(v: Views):
    return summarise(v.dense).select(
        "window_start", "window_end", "node_id", *r9(*SUMMARY), "record_count"
    )


@query("i2_valid_records", f"""
SELECT j ->> '$.node_id' AS node_id, CAST(j ->> '$.timestamp' AS BIGINT) AS timestamp,
       {_number('voltage')} AS voltage, {_number('energy_wh')} AS energy_wh
FROM (SELECT *, {_suite_sql()} AS reason FROM ({PARSED})) WHERE reason = '{msg.SUITE_OK}'""")
def _(v: Views):
    records = msg.valid_records(msg.envelope(v.messages))
    return records.select("node_id", "timestamp", "voltage", "energy_wh")


@query("j1_detector_features", CELL_SQL)
def _(v: Views):
    return scaling.detector_features(v.telemetry).select("event_id", "node_id", *SCALED)


@query("j2_standardise", "SELECT event_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 9) AS {c}_scaled" for c in SCALED
) + f" FROM ({CELL_SQL})")
def _(v: Views):
    frame = scaling.detector_features(v.telemetry)
    scaled = scaling.apply_standard(frame, scaling.fit_standard(frame))
    return scaled.select("event_id", *r9(*[f"{c}_scaled" for c in SCALED]))


@query("j3_cell_counts", f"""
SELECT hour_of_day, day_of_week, is_active, CAST(count(*) AS BIGINT) AS n
FROM ({CELL_SQL}) GROUP BY 1, 2, 3""")
def _(v: Views):
    return forest.cell_counts(v.telemetry)


def _chance(what: str) -> str:
    return f"('0x' || substr(md5('42:' || tree_id || ':{what}:' || {'i' if what == 'draw' else 'node'}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def _average_path(n: str) -> str:
    return (
        f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE "
        f"2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649) - 2 * ({n} - 1.0::DOUBLE) / {n} END"
    )


SPANS = ", ".join(
    f"min({c}) OVER node AS low_{i}, max({c}) OVER node AS high_{i}" for i, c in enumerate(SCALED)
)
VARYING = ", ".join(f"CASE WHEN high_{i} > low_{i} THEN {i} END" for i in range(3))
PICK = lambda stem: " ".join(f"WHEN {i} THEN {stem(i)}" for i in range(3))
# Rows of a node know its split: the feature by one number named after the node, the cut by another.
SPLIT_SQL = f"""
SELECT *, CASE WHEN feature >= 0 THEN CASE feature {PICK(lambda i: f"low_{i}::DOUBLE")} END
            + {_chance("cut")} * (CASE feature {PICK(lambda i: f"(high_{i} - low_{i})")} END)
            ELSE 0 END AS threshold
FROM (SELECT *, CASE WHEN depth >= deepest OR len(varying) = 0 THEN -1
       ELSE varying[1 + floor({_chance("feature")} * len(varying))::INTEGER] END AS feature
  FROM (SELECT *, [f FOR f IN [{VARYING}] IF f IS NOT NULL] AS varying
    FROM (SELECT *, {SPANS} FROM {{rows}} WINDOW node AS (PARTITION BY tree_id, node))))"""
FOREST_SQL = f"""
WITH RECURSIVE cell AS (
  SELECT *, sum(n) OVER (ORDER BY {", ".join(SCALED)}) AS cum, sum(n) OVER () AS total
  FROM (SELECT {", ".join(SCALED)}, count(*) AS n FROM ({CELL_SQL}) GROUP BY ALL)
), draw AS (
  SELECT tree_id, i, floor({_chance("draw")} * total)::BIGINT AS pos, total
  FROM range(100) AS t(tree_id), range(20000) AS r(i), (SELECT any_value(total) AS total FROM cell)
), kept AS (
  SELECT tree_id, pos FROM (SELECT tree_id, pos, min(i) AS i, any_value(total) AS total
    FROM draw GROUP BY tree_id, pos)
  QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY i) <= least(256, total)
), drawn AS (
  SELECT tree_id, {", ".join(SCALED)}, count(*) AS w,
         greatest(1, ceil(log2(sum(count(*)) OVER (PARTITION BY tree_id))))::INTEGER AS deepest
  FROM kept JOIN cell ON pos >= cum - n AND pos < cum GROUP BY tree_id, {", ".join(SCALED)}
), grown AS (
  SELECT tree_id, 1 AS node, 0 AS depth, {", ".join(SCALED)}, w, deepest FROM drawn
  UNION ALL
  SELECT tree_id, 2 * node + CASE WHEN CASE feature {PICK(lambda i: SCALED[i])} END > threshold
         THEN 1 ELSE 0 END, depth + 1, {", ".join(SCALED)}, w, deepest
  FROM ({SPLIT_SQL.format(rows="grown")}) WHERE feature >= 0
), trees AS (
  SELECT tree_id, node, any_value(feature) AS feature, any_value(threshold) AS threshold,
         any_value(depth) AS depth, sum(w) AS size
  FROM ({SPLIT_SQL.format(rows="grown")}) GROUP BY tree_id, node
)"""
TREES_SQL = f"""{FOREST_SQL}
SELECT tree_id::INTEGER AS tree_id, node::INTEGER AS node, feature::INTEGER AS feature, threshold,
       CASE WHEN feature < 0 THEN -1 ELSE 2 * node END::INTEGER AS left_node,
       CASE WHEN feature < 0 THEN -1 ELSE 2 * node + 1 END::INTEGER AS right_node,
       depth::INTEGER AS depth, size::INTEGER AS size FROM trees"""


def _scored_sql(contamination: float) -> str:
    """Scores of all cells: every cell walks every tree, then the offset is taken off."""
    return f"""{FOREST_SQL}, walk AS (
  SELECT tree_id, h AS hour_of_day, d AS day_of_week, a AS is_active, 1 AS node
  FROM range(100) AS t(tree_id), range(24) AS x(h), range(7) AS y(d), range(2) AS z(a)
  UNION ALL
  SELECT walk.tree_id, hour_of_day, day_of_week, is_active,
         2 * node + CASE WHEN CASE feature {PICK(lambda i: SCALED[i])} END > threshold
         THEN 1 ELSE 0 END
  FROM walk JOIN trees USING (tree_id, node) WHERE feature >= 0
), raw AS (
  SELECT {", ".join(SCALED)}, -pow(2.0::DOUBLE, -avg(
    (t.depth + {_average_path("t.size")}) / ({_average_path("r.size")}))) AS raw
  FROM walk JOIN trees t USING (tree_id, node) JOIN trees r ON r.tree_id = walk.tree_id AND r.node = 1
  WHERE t.feature < 0 GROUP BY ALL
), ranked AS (
  SELECT raw, sum(n) OVER (ORDER BY raw, {", ".join(SCALED)}) AS cum,
         (sum(n) OVER () - 1) * {contamination}::DOUBLE AS pos
  FROM raw JOIN cell USING ({", ".join(SCALED)})
), ends AS (
  SELECT min(raw) FILTER (cum > floor(pos)) AS low, min(raw) FILTER (cum > ceil(pos)) AS high,
         max(pos - floor(pos)) AS share FROM ranked
), scored AS (
  SELECT {", ".join(SCALED)}, raw - (low + (high - low) * share) AS score FROM raw, ends
), readings AS (
  SELECT t.node_id, t.timestamp, score, {SEVERITY_SQL} AS severity
  FROM telemetry t JOIN ({CELL_SQL}) c USING (event_id) JOIN scored USING ({", ".join(SCALED)})
)"""


@query("j3_isolation_trees", TREES_SQL)
def _(v: Views):
    return forest.grow_trees(forest.cell_counts(v.telemetry))


@query("j4_anomaly_scores", f"""{_scored_sql(forest.CONTAMINATION)}
SELECT node_id, timestamp, round_even(score, 6) AS anomaly_score, severity FROM readings""")
def _(v: Views):
    counts = materialise(forest.cell_counts(v.telemetry))  # at most 336 rows, used twice
    return forest.detect(v.telemetry, forest.score_cells(forest.grow_trees(counts), counts))


@query("j6_training_metrics", f"""{_scored_sql(forest.CONTAMINATION)}
SELECT round_even(count(*) FILTER (severity <> 'normal') / count(*)::DOUBLE, 4) AS anomaly_rate,
       count(*)::DOUBLE AS n_readings FROM readings""")
def _(v: Views):
    counts = materialise(forest.cell_counts(v.telemetry))
    cells = forest.score_cells(forest.grow_trees(counts), counts)
    metrics = runs.scoring_metrics(forest.detect(v.telemetry, cells))
    return metrics.select(
        "anomaly_rate", F.col("n_readings").cast("double").alias("n_readings")
    )


@query("i8_gated_anomalies", f"""{_scored_sql(forest.JOB_CONTAMINATION)}
SELECT node_id, timestamp, '{ANOMALY_TYPE}' AS anomaly_type, round_even(score, 6) AS score, severity
FROM readings WHERE severity <> 'normal' AND node_id IN (
  SELECT node_id FROM telemetry GROUP BY node_id HAVING {FEB_01} - min(timestamp) >= 2592000000)""")
def _(v: Views):
    counts = materialise(forest.cell_counts(v.telemetry))
    cells = forest.score_cells(
        forest.grow_trees(counts), counts, forest.JOB_CONTAMINATION
    )
    gated = nodes.past_learning(v.telemetry, nodes.first_seen(v.telemetry), FEB_01)
    return anomalies_of(forest.detect(gated, cells))


@query("j8_quarter_hour_meters", """
SELECT node_id, ms AS timestamp_ms, round(p, 9) AS power_w, v AS voltage,
       round(greatest(0.0, least(150.0, CASE WHEN m IS NOT NULL AND m > 0 THEN m
         ELSE p / (v * pf + 1e-9) END)), 9) AS current,
       round(kw * 0.25 * 1000.0, 9) AS energy_wh, pf AS power_factor
FROM (SELECT *, greatest(0.0, kw * 1000.0) AS p FROM (
  SELECT "household_ID" AS node_id, try_cast("timestamp" AS BIGINT) AS ms,
         try_cast("avgimportkw(kw)" AS DOUBLE) AS kw,
         try_cast("phaseainstvoltage(v)" AS DOUBLE) AS v,
         try_cast("phaseainstcurrent(a)" AS DOUBLE) AS m,
         greatest(0.1, least(1.0, coalesce(try_cast("powerfactor" AS DOUBLE), 0.85))) AS pf
  FROM quarter_hour))
WHERE ms IS NOT NULL AND kw IS NOT NULL AND v BETWEEN 200 AND 260""")
def _(v: Views):
    out = meters.normalise_quarter_hour(v.quarter_hour)
    return out.select(
        "node_id", "timestamp_ms", "voltage", *r9("power_w", "current", "energy_wh"),
        "power_factor",
    )


@query("j9_minute_household", """
SELECT 'uci-household-main' AS node_id,
       epoch_ms(strptime("Date" || ' ' || "Time", '%d/%m/%Y %H:%M:%S')) AS timestamp,
       CAST("Voltage" AS DOUBLE) AS voltage, CAST("Global_intensity" AS DOUBLE) AS current,
       round(CAST("Global_active_power" AS DOUBLE) * 1000, 2) AS power,
       CAST("Sub_metering_1" AS DOUBLE) + CAST("Sub_metering_2" AS DOUBLE)
         + CAST("Sub_metering_3" AS DOUBLE) AS energy_wh
FROM minute_rows WHERE "Global_active_power" <> '?' AND "Sub_metering_2" <> '?'""")
def _(v: Views):
    return meters.normalise_minute(v.minute_rows)


@query("j10_min_max_round_trip", """
WITH s AS (SELECT min(list_min(w)) AS low, max(list_max(w)) AS high FROM windows)
SELECT node_id, start_ms, round((w[1] - low) / (high - low), 9) AS scaled_first,
       round(greatest(0.0, w[1]), 9) AS restored_first
FROM windows, s""")
def _(v: Views):
    windows = sequences.sliding_windows(v.hourly)
    scaler = scaling.fit_min_max(windows)
    scaled = scaling.apply_min_max(windows, scaler, ["x"]).withColumn("back", F.col("x"))
    both = scaling.invert_min_max(scaled, scaler, ["back"])
    return both.select(
        "node_id", "start_ms", F.round(F.col("x")[0], 9).alias("scaled_first"),
        F.round(F.col("back")[0], 9).alias("restored_first"),
    )


def _least_squares_sql(windows: str) -> str:
    """The fitted model, ``solved`` (i, j, v): weight i (0 is the intercept) of horizon j - 11.

    The normal equations of all horizons at once, by elimination: step p makes column p a unit column.
    """
    return f"""
train AS (SELECT * FROM ({windows}) WHERE rn % 2 = 1),
fit AS (SELECT min(list_min(w)) AS low, max(list_max(w)) AS high FROM train),
spread AS (SELECT low, CASE WHEN high > low THEN high - low ELSE 1 END AS span FROM fit),
design AS (
  SELECT list_prepend(1.0::DOUBLE, [(v - low) / span FOR v IN w]) AS z FROM train, spread
), sums AS (
  SELECT i, j, sum(z[i + 1] * z[j + 1]) AS v FROM design, range(11) AS a(i), range(35) AS b(j)
  GROUP BY i, j
), steps AS (
  SELECT 0 AS p, i, j, v FROM sums
  UNION ALL
  SELECT p + 1, i, j, CASE WHEN i = p THEN row_v / lead_v ELSE v - col_v * row_v / lead_v END
  FROM (SELECT *, max(CASE WHEN i = p THEN v END) OVER (PARTITION BY j) AS row_v,
               max(CASE WHEN j = p THEN v END) OVER (PARTITION BY i) AS col_v,
               max(CASE WHEN i = p AND j = p THEN v END) OVER () AS lead_v FROM steps)
  WHERE p < 11
), solved AS (SELECT i, j, v FROM steps WHERE p = 11 AND j >= 11)"""


def _predicted_sql(inputs: str) -> str:
    """Normalised predictions of ``inputs`` (any columns and z, ten normalised values)."""
    return f"""
SELECT q.*, j - 11 AS horizon,
       greatest(0.0::DOUBLE, sum(v * CASE WHEN i = 0 THEN 1 ELSE z[i] END)) AS yhat
FROM ({inputs}) q, solved GROUP BY ALL"""


SPLIT_WINDOWS = """
SELECT node_id, rn, part, w FROM (
  SELECT node_id, part, row_number() OVER (PARTITION BY node_id, part ORDER BY timestamp) AS rn,
         list(avg_power) OVER (PARTITION BY node_id, part ORDER BY timestamp
           ROWS BETWEEN CURRENT ROW AND 33 FOLLOWING) AS w
  FROM (SELECT *, rn <= floor(n * (1.0::DOUBLE - 0.2::DOUBLE)) AS part FROM numbered))
WHERE len(w) = 34"""


def _fitted(hourly):
    return forecasting.fit_linear(
        sequences.sliding_windows(hourly, stride=sequences.TRAIN_STRIDE)
    )


@query("j11_forecaster_model", f"""
WITH RECURSIVE {_least_squares_sql("SELECT * FROM windows")}
SELECT (j - 11)::INTEGER AS horizon, i::INTEGER AS term, round(v, 6) + 0 AS weight FROM solved""")
def _(v: Views):
    model, _ = _fitted(v.hourly)
    terms = model.select(
        "horizon", F.posexplode(F.concat(F.array("intercept"), "weights")).alias("term", "weight")
    )
    return terms.select("horizon", "term", (F.round("weight", 6) + F.lit(0.0)).alias("weight"))


@query("j12_fitted_forecast", f"""
WITH RECURSIVE {_least_squares_sql("SELECT * FROM windows")}, recent AS (
  SELECT node_id, list(avg_power ORDER BY timestamp) AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC) AS back
        FROM steady WHERE timestamp >= {JAN_31 - 11 * 3600000})
  WHERE back <= 10 GROUP BY node_id HAVING count(*) = 10
)
SELECT node_id, {JAN_31} + horizon * 3600000 AS timestamp,
       round(greatest(0.0::DOUBLE, yhat * span + low), 6) AS predicted_consumption
FROM ({_predicted_sql("SELECT node_id, [(v - low) / span FOR v IN x] AS z FROM recent, spread")}),
     spread""")
def _(v: Views):
    model, scaler = _fitted(v.hourly)
    out = forecasting.forecast(v.steady, model, scaler, JAN_31)
    return out.withColumn("predicted_consumption", F.round("predicted_consumption", 6))


@query("j12_mean_forecast", f"""
SELECT node_id, {JAN_31} + h * 3600000 AS timestamp,
       round(greatest(0.0, m), 6) AS predicted_consumption
FROM (SELECT node_id, avg(avg_power) AS m FROM (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC) AS back
        FROM steady WHERE timestamp >= {JAN_31 - 11 * 3600000}) WHERE back <= 10
      GROUP BY node_id HAVING count(*) = 10), range(24) AS r(h)""")
def _(v: Views):
    # An identity scaler: the model works in watts.
    scaler = v.hourly.agg(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    out = forecasting.forecast(v.steady, forecasting.mean_model(v.spark), scaler, JAN_31)
    return out.withColumn("predicted_consumption", F.round("predicted_consumption", 6))


@query("j14_holdout_errors", f"""
WITH RECURSIVE {_least_squares_sql(f"SELECT * FROM ({SPLIT_WINDOWS}) WHERE part")}, held AS (
  SELECT node_id, rn, [(v - low) / span FOR v IN w] AS z
  FROM ({SPLIT_WINDOWS}), spread WHERE NOT part
), errors AS (
  SELECT yhat - z[11 + horizon] AS e, z[11 + horizon] AS y FROM ({_predicted_sql("SELECT * FROM held")})
)
SELECT round(sqrt(sum(e * e) / count(*)), 9) AS test_rmse,
       round(sum(abs(e / (abs(y) + 1e-8))) / count(*), 9) AS test_mape FROM errors"""
)
def _(v: Views):
    split = sequences.time_split(v.hourly)
    model, scaler = _fitted(split.where("split = 'train'"))
    held_out = sequences.sliding_windows(split.where("split = 'test'"))
    errors = forecasting.forecast_errors(
        forecasting.predict_normalised(held_out, model, scaler)
    )
    return errors.select(*r9("test_rmse", "test_mape"))


@query("j15_promotions", """
WITH m AS (SELECT *, CASE experiment WHEN 'load-forecasting' THEN test_mape
                     ELSE anomaly_rate END AS metric FROM runs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY metric, ts, run_id) AS rn,
                  row_number() OVER (PARTITION BY experiment ORDER BY ts DESC, run_id DESC) AS age,
                  count(*) OVER (PARTITION BY experiment) AS n FROM m)
SELECT a.experiment, a.run_id, CAST(a.n AS BIGINT) AS runs, a.metric, b.metric AS runner_up,
       a.n > 1 AND coalesce(a.metric < b.metric, false) AS promoted
FROM ranked a LEFT JOIN ranked b ON a.experiment = b.experiment AND b.rn = 2 WHERE a.age = 1""")
def _(v: Views):
    return runs.promotions(v.runs)


@query("j16_run_comparison", """
SELECT run_id, experiment, ts, test_mape AS metric FROM runs
WHERE experiment = 'load-forecasting'""")
def _(v: Views):
    return runs.compare_runs(v.runs, "load-forecasting", "test_mape")


AHEAD = f"SELECT * FROM forecasts WHERE timestamp >= {JAN_30} AND timestamp < {JAN_31}"
WORST = f"""
SELECT node_id, score, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score, timestamp) AS rn
  FROM anomalies WHERE severity IN ('high', 'medium') AND timestamp >= {JAN_30 - 6 * 3600000})
WHERE rn = 1"""
K1 = f"""
SELECT node_id, 'high_anomaly' AS type, severity,
       'Node ' || node_id || ' flagged with ' || severity || '-severity anomaly (score '
       || printf('%.3f', score) || '). Inspect for irregular consumption.' AS message,
       score AS anomaly_score, CAST(NULL AS VARCHAR) AS peak_hours,
       CAST(NULL AS DOUBLE) AS max_consumption_watts FROM ({WORST})"""
K2 = f"""
SELECT node_id, 'high_consumption' AS type, 'high' AS severity,
       'Node ' || node_id || ' forecast exceeds 800W (peak: '
       || printf('%.0f', round_even(peak, 0)) || 'W). Review connected loads.' AS message,
       CAST(NULL AS DOUBLE) AS anomaly_score, CAST(NULL AS VARCHAR) AS peak_hours,
       peak AS max_consumption_watts
FROM (SELECT node_id, max(predicted_consumption) AS peak FROM ({AHEAD})
      WHERE predicted_consumption >= 800 GROUP BY 1)"""
K3 = f"""
SELECT node_id, 'load_shift' AS type, 'medium' AS severity,
       'Node ' || node_id || ' forecast shows peak consumption ('
       || printf('%.0f', round_even(peak, 0)) || 'W) at '
       || string_agg(printf('%02d:00', h), ', ' ORDER BY h)
       || '. Consider shifting deferrable loads to off-peak hours.' AS message,
       CAST(NULL AS DOUBLE) AS anomaly_score,
       string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS peak_hours,
       peak AS max_consumption_watts
FROM (SELECT DISTINCT node_id, timestamp // 3600000 % 24 AS h,
             max(predicted_consumption) OVER (PARTITION BY node_id) AS peak
      FROM ({AHEAD}) WHERE predicted_consumption >=
        (SELECT quantile_cont(predicted_consumption, 0.9) FROM ({AHEAD})))
GROUP BY node_id, peak"""
K_COLUMNS = [
    "node_id", "type", "severity", "message", "anomaly_score", "peak_hours",
    "max_consumption_watts",
]


def _flat(recommendations):
    texts = F.array_join("peak_hours", ",").alias("peak_hours")
    return recommendations.select(*[texts if c == "peak_hours" else c for c in K_COLUMNS])


@query("k1_high_anomaly", K1)
def _(v: Views):
    return _flat(recommend.anomaly_rule(recommend.recent_anomalies(v.anomalies, JAN_30)))


@query("k2_high_consumption", K2)
def _(v: Views):
    return _flat(recommend.consumption_rule(recommend.upcoming_forecasts(v.forecasts, JAN_30)))


@query("k3_load_shift", K3)
def _(v: Views):
    return _flat(recommend.load_shift_rule(recommend.upcoming_forecasts(v.forecasts, JAN_30)))


K4 = f"""
SELECT * FROM ({K1}) UNION ALL SELECT * FROM ({K2}) UNION ALL SELECT * FROM ({K3}) k
WHERE NOT EXISTS (SELECT 1 FROM ({K2}) h WHERE h.node_id = k.node_id)"""


@query("k4_combined_rules", K4)
def _(v: Views):
    ahead = recommend.upcoming_forecasts(v.forecasts, JAN_30)
    return _flat(
        recommend.combine(
            recommend.anomaly_rule(recommend.recent_anomalies(v.anomalies, JAN_30)),
            recommend.consumption_rule(ahead),
            recommend.load_shift_rule(ahead),
        )
    )


@query("b34_metadata_objects", f"""
SELECT node_id, type, anomaly_score, max_consumption_watts, peak_hours IS NOT NULL AS has_hours
FROM ({K4})""")
def _(v: Views):
    out = recommend.recommendations(v.anomalies, v.forecasts, JAN_30)
    of = lambda key: F.get_json_object("metadata_json", f"$.{key}")
    return out.select(
        "node_id",
        "type",
        of("anomaly_score").cast("double").alias("anomaly_score"),
        of("max_consumption_watts").cast("double").alias("max_consumption_watts"),
        of("peak_hours").isNotNull().alias("has_hours"),
    )


@query("k5_recommendations", f"SELECT *, {JAN_30} AS generated_ms FROM ({K4})")
def _(v: Views):
    out = recommend.recommendations(v.anomalies, v.forecast_runs, JAN_30)
    stamp = F.unix_millis("generated_at").alias("generated_ms")
    texts = F.array_join("peak_hours", ",").alias("peak_hours")
    return out.select(*[texts if c == "peak_hours" else c for c in K_COLUMNS], stamp)


# The cutoff of a run on 15 February is 16 January.
RETENTION_RUN = JAN_16 + 30 * 86_400_000


def _counts_sql(tables: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, "
        f"CAST(count(*) FILTER ({column} >= {JAN_16}) AS BIGINT) AS kept, "
        f"CAST(count(*) FILTER ({column} < {JAN_16}) AS BIGINT) AS deleted FROM {view}"
        for name, (view, column) in tables.items()
    )


BY_TIME_SQL = _counts_sql(
    {
        "telemetry_readings": ("telemetry", "timestamp"),
        "node_events": ("dense", "timestamp"),
        "node_health": ("health", "timestamp"),
        "anomaly_records": ("anomalies", "timestamp"),
        "forecasts": ("forecasts", "timestamp"),
    }
)
BY_CREATION_SQL = _counts_sql(
    {
        "energy_features": ("hourly", "timestamp + reading_count % 3 * 864000000"),
        "energy_analytics_hourly": ("hourly_rollup", "hour_ms + reading_count % 3 * 864000000"),
        "energy_analytics_daily": (
            "daily_rollup", "day * 86400000 + reading_count % 3 * 864000000"
        ),
    }
)


def _by_time(v: Views):
    return {
        "telemetry_readings": v.telemetry,
        "node_events": v.dense,
        "node_health": v.health,
        "anomaly_records": v.anomalies,
        "forecasts": v.forecasts,
    }


def _by_creation(v: Views):
    partials = rollups.hourly_partials(v.telemetry)
    # Created up to twenty days after the time that a row is about.
    late = F.col("reading_count").cast("bigint") % 3 * 864_000_000
    created = lambda ms: F.timestamp_millis((F.col(ms) if isinstance(ms, str) else ms) + late)
    daily = rollups.daily_from_partials(partials, v.metadata)
    day = F.unix_date("date").cast("bigint") * 86_400_000
    return {
        "energy_features": v.hourly.withColumn("created_at", created("timestamp")),
        "energy_analytics_hourly": rollups.hourly_from_partials(partials, v.metadata).withColumn(
            "created_at", created("hour_ms")
        ),
        "energy_analytics_daily": daily.withColumn("created_at", created(day)),
    }


@query("l1_retention_by_event_time", BY_TIME_SQL)
def _(v: Views):
    return retention.retention_counts(_by_time(v), RETENTION_RUN)


@query("l1_kept_readings", f"SELECT event_id FROM telemetry WHERE timestamp >= {JAN_16}")
def _(v: Views):
    return retention.kept(v.telemetry, "telemetry_readings", RETENTION_RUN).select("event_id")


@query("l2_retention_by_creation", BY_CREATION_SQL)
def _(v: Views):
    return retention.retention_counts(_by_creation(v), RETENTION_RUN)


@query("l3_total_deleted", f"""
SELECT CAST(sum(deleted) AS BIGINT) AS total_deleted
FROM ({BY_TIME_SQL} UNION ALL {BY_CREATION_SQL})""")
def _(v: Views):
    both = {**_by_time(v), **_by_creation(v)}
    return retention.total_deleted(retention.retention_counts(both, RETENTION_RUN))


@query("l4_hourly_analytics", f"""
SELECT node_id, division, hour_ms, {r9_sql(*ROLLUP)}, reading_count FROM hourly_rollup
WHERE division = 'NATION_10' AND hour_ms >= {JAN_16} ORDER BY hour_ms DESC, node_id LIMIT 1000""")
def _(v: Views):
    hourly = rollups.hourly_rollup(v.telemetry, v.metadata)
    rows = serving.hourly_analytics(hourly, division="NATION_10", start_ms=JAN_16, limit=1000)
    return rows.select(
        "node_id", "division", F.unix_millis("hour_start").alias("hour_ms"),
        *r9(*ROLLUP), "reading_count",
    )


@query("l5_daily_analytics", f"""
SELECT node_id, division, {DAY_TEXT} AS date, {r9_sql(*ROLLUP)},
       CAST(reading_count AS BIGINT) AS reading_count FROM daily_rollup
WHERE {DAY_TEXT} BETWEEN '2024-01-05' AND '2024-01-25' ORDER BY day DESC, node_id LIMIT 500""")
def _(v: Views):
    daily = rollups.daily_rollup(v.telemetry, v.metadata)
    rows = serving.daily_analytics(daily, start="2024-01-05", end="2024-01-25", limit=500)
    return rows.select(
        "node_id", "division", F.col("date").cast("string").alias("date"),
        *r9(*ROLLUP), "reading_count",
    )


@query("l6_anomaly_records", """
SELECT * FROM anomalies WHERE severity = 'high' ORDER BY timestamp DESC, node_id, score LIMIT 100""")
def _(v: Views):
    return serving.anomaly_records(v.anomalies, severity="high")


@query("l7_forecast_records", """
SELECT node_id, timestamp, arg_max(predicted_consumption, run_ts) AS predicted_consumption
FROM forecast_runs WHERE node_id = 'node_7' GROUP BY 1, 2 ORDER BY timestamp, node_id LIMIT 1000""")
def _(v: Views):
    return serving.forecast_records(v.forecast_runs, node_id="node_7", limit=1000)


@query("l8_telemetry_history", f"""
SELECT {FIELDS} FROM telemetry WHERE timestamp >= {FEB_01 - 30 * 86400000}
AND timestamp < {FEB_01} ORDER BY timestamp DESC, node_id LIMIT 1000""")
def _(v: Views):
    return serving.telemetry_history(v.telemetry, FEB_01, limit=1000)


@query("l9_batch_analytics", f"""
SELECT 'hourly' AS grain, node_id, division, hour_ms AS start_ms, {r9_sql(*ROLLUP)},
       CAST(reading_count AS BIGINT) AS reading_count FROM hourly_rollup
UNION ALL
SELECT 'daily', node_id, division, day * 86400000, {r9_sql(*ROLLUP)},
       CAST(reading_count AS BIGINT) FROM daily_rollup""")
def _(v: Views):
    partials = rollups.hourly_partials(v.telemetry)
    hourly = rollups.hourly_from_partials(partials, v.metadata)
    daily = rollups.daily_from_partials(partials, v.metadata)
    fields = ["node_id", "division", "start_ms"]
    start = F.unix_date("date").cast("bigint") * 86_400_000
    parts = [
        hourly.withColumn("start_ms", F.col("hour_ms")).select(
            F.lit("hourly").alias("grain"), *fields, *r9(*ROLLUP), "reading_count"
        ),
        daily.withColumn("start_ms", start).select(
            F.lit("daily").alias("grain"), *fields, *r9(*ROLLUP), "reading_count"
        ),
    ]
    return parts[0].unionByName(parts[1])


@query("l10_feature_table", f"""
SELECT node_id, timestamp, {r9_sql(*HOURLY)}, CAST(reading_count AS INTEGER) AS reading_count,
       CAST(timestamp // 3600000 % 24 AS INTEGER) AS hour,
       CAST((timestamp // 86400000 + 4) % 7 + 1 AS INTEGER) AS day_of_week,
       CAST(day(make_timestamp(timestamp * 1000)) AS INTEGER) AS day_of_month,
       {LAG_SQL},
       {rounded({**ROLLING_SQL, **DAY_STATS_SQL})},
       '2.0' AS pipeline_version, 'hourly' AS aggregation_level FROM hourly""")
def _(v: Views):
    table = feat.engineer_features(v.hourly)
    rolled = [F.round(c, 8).alias(c) for c in [*ROLLING_SQL, *DAY_STATS_SQL]]
    return table.select(
        "node_id", "timestamp", *r9(*HOURLY), "reading_count", "hour", "day_of_week",
        "day_of_month", *r9(*feat.LAG_ROWS), *rolled, "pipeline_version", "aggregation_level",
    )
