"""Queries: projections, filters, scalar expressions and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as msg
from ..functions import numeric as num
from ..functions import text, timecols
from ..functions.severity import is_anomalous, severity
from ..operators import forecasting, keyed, meters, nodes, ranked, recommend, rollups, serving
from ..operators.features import hourly_features, with_lineage
from ..operators.quality import arrival_interval
from ..schemas import MEASURES, READING_FIELDS, TABLES
from ..streaming.windows import live_feed, summarise, summary_messages
from .registry import query, r9, r9_sql
from .standins import FEB_01, JAN_16, JAN_29, JAN_30, JAN_31, Views

FIELDS = ", ".join(READING_FIELDS)
KEY = ["event_id", "node_id"]


@query("a7_insert_if_absent", f"""
SELECT {FIELDS} FROM (
  SELECT *, row_number() OVER (PARTITION BY node_id, timestamp ORDER BY seq) AS rn
  FROM deliveries) d
WHERE rn = 1 AND NOT EXISTS (
  SELECT 1 FROM telemetry s WHERE s.timestamp < {JAN_16}
  AND s.node_id = d.node_id AND s.timestamp = d.timestamp)""")
def _(v: Views):
    stored = v.telemetry.where(F.col("timestamp") < JAN_16)
    new = keyed.insert_if_absent(v.deliveries, stored, ["node_id", "timestamp"], "seq")
    return new.select(*READING_FIELDS)


@query("a13_topic_routing", """
SELECT event_id, CASE
  WHEN regexp_matches(topic, '^energy/nodes/[^/]+/telemetry$') THEN 'telemetry'
  WHEN regexp_matches(topic, '^energy/nodes/[^/]+/events$') THEN 'events'
  WHEN regexp_matches(topic, '^energy/nodes/[^/]+/health$') THEN 'health' END AS route
FROM messages""")
def _(v: Views):
    return v.messages.select("event_id", msg.route("topic").alias("route"))


@query("a19_duplicate_keys", """
SELECT node_id, timestamp, CAST(count(*) AS BIGINT) AS copies FROM deliveries
GROUP BY 1, 2 HAVING count(*) > 1""")
def _(v: Views):
    return keyed.duplicate_keys(v.deliveries, ["node_id", "timestamp"])


@query("b1_pruned_projection", "SELECT node_id, timestamp, power, energy_wh FROM telemetry")
def _(v: Views):
    return v.telemetry.select("node_id", "timestamp", "power", "energy_wh")


@query("b2_rename", "SELECT node_id, node_type, location AS division FROM metadata")
def _(v: Views):
    return v.metadata.withColumnsRenamed({"location": "division"})


@query("b3_event_time", "SELECT event_id, timestamp AS event_ms FROM telemetry")
def _(v: Views):
    return v.telemetry.select(
        "event_id", F.unix_millis(timecols.event_time("timestamp")).alias("event_ms")
    )


@query("b4_event_time_seconds",
       "SELECT event_id, timestamp // 1000 * 1000 AS event_ms FROM telemetry")
def _(v: Views):
    return v.telemetry.select(
        "event_id", F.unix_millis(timecols.event_time_seconds("timestamp")).alias("event_ms")
    )


@query("b5_hour_bucket",
       "SELECT event_id, timestamp // 3600000 * 3600000 AS hour_ms FROM telemetry")
def _(v: Views):
    return v.telemetry.select("event_id", timecols.hour_ms("timestamp").alias("hour_ms"))


@query("b6_day_bucket", """
SELECT event_id, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS date
FROM telemetry""")
def _(v: Views):
    return v.telemetry.select(
        "event_id", timecols.utc_date("timestamp").cast("string").alias("date")
    )


@query("b7_calendar_fields", """
SELECT event_id, CAST(hour(t) AS INTEGER) AS hour, CAST(dayofweek(t) + 1 AS INTEGER) AS day_of_week,
       CAST(day(t) AS INTEGER) AS day_of_month
FROM (SELECT event_id, make_timestamp(timestamp * 1000) AS t FROM telemetry)""")
def _(v: Views):
    return v.telemetry.select(
        "event_id",
        timecols.utc_hour("timestamp").alias("hour"),
        timecols.day_of_week_sunday1("timestamp").alias("day_of_week"),
        timecols.day_of_month("timestamp").alias("day_of_month"),
    )


@query("b8_weekday", """
SELECT event_id, CAST(hour(t) AS INTEGER) AS hour_of_day,
       CAST(isodow(t) - 1 AS INTEGER) AS day_of_week
FROM (SELECT event_id, make_timestamp(timestamp * 1000) AS t FROM telemetry)""")
def _(v: Views):
    return v.telemetry.select(
        "event_id",
        timecols.utc_hour("timestamp").alias("hour_of_day"),
        timecols.weekday_monday0("timestamp").alias("day_of_week"),
    )


@query("b9_is_active", """
SELECT event_id, CAST(CASE WHEN power > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_active
FROM telemetry""")
def _(v: Views):
    return v.telemetry.select("event_id", num.is_active().alias("is_active"))


@query("b10_lineage", """
SELECT node_id, timestamp, timestamp AS feature_ms, '2.0' AS pipeline_version,
       'hourly' AS aggregation_level FROM hourly""")
def _(v: Views):
    return with_lineage(v.hourly).select(
        "node_id", "timestamp", F.unix_millis("feature_timestamp").alias("feature_ms"),
        "pipeline_version", "aggregation_level",
    )


@query("b11_coerce", """
SELECT event_id, try_cast("timestamp" AS DOUBLE) AS ms,
       try_cast("phaseainstvoltage(v)" AS DOUBLE) AS voltage FROM quarter_hour""")
def _(v: Views):
    return v.quarter_hour.select(
        "event_id",
        num.to_double("timestamp").alias("ms"),
        num.to_double(F.col("`phaseainstvoltage(v)`")).alias("voltage"),
    )


@query("b12_drop_nulls", """
SELECT event_id, "powerfactor" AS power_factor FROM quarter_hour
WHERE "powerfactor" IS NOT NULL""")
def _(v: Views):
    named = v.quarter_hour.select("event_id", F.col("powerfactor").alias("power_factor"))
    return named.dropna(subset=["power_factor"])


@query("b13_clip", """
SELECT event_id, CASE WHEN power IS NULL THEN NULL
  ELSE greatest(0.5, least(150.0, power)) END AS clipped FROM telemetry""")
def _(v: Views):
    return v.telemetry.select("event_id", num.clip("power", 0.5, 150.0).alias("clipped"))


@query("b14_null_default", """
SELECT event_id, coalesce(try_cast("powerfactor" AS DOUBLE), 0.85) AS power_factor
FROM quarter_hour""")
def _(v: Views):
    factor = F.coalesce(num.to_double("powerfactor"), F.lit(0.85))
    return v.quarter_hour.select("event_id", factor.alias("power_factor"))


@query("b15_derived_current", f"""
SELECT event_id, round(CASE WHEN m IS NOT NULL AND m > 0 THEN m
  ELSE p / (230.0 * 0.95 + 1e-9) END, 9) AS current
FROM (SELECT event_id, try_cast("phaseainstcurrent(a)" AS DOUBLE) AS m,
             coalesce(try_cast("avgimportkw(kw)" AS DOUBLE), 0) * 1000.0 AS p FROM quarter_hour)""")
def _(v: Views):
    typed = v.quarter_hour.select(
        "event_id",
        num.to_double(F.col("`phaseainstcurrent(a)`")).alias("m"),
        (F.coalesce(num.to_double(F.col("`avgimportkw(kw)`")), F.lit(0.0)) * 1000.0).alias("p"),
    )
    amps = num.measured_or_derived_current("m", "p", F.lit(230.0), F.lit(0.95))
    return typed.select("event_id", F.round(amps, 9).alias("current"))


@query("b16_voltage_band", """
SELECT event_id, v AS voltage
FROM (SELECT event_id, try_cast("phaseainstvoltage(v)" AS DOUBLE) AS v FROM quarter_hour)
WHERE v BETWEEN 200 AND 260""")
def _(v: Views):
    volts = num.to_double(F.col("`phaseainstvoltage(v)`")).alias("voltage")
    typed = v.quarter_hour.select("event_id", volts)
    return typed.where(F.col("voltage").between(200, 260))


@query("b17_unit_conversion", """
SELECT event_id, round(greatest(0.0, kw * 1000.0), 9) AS power_w,
       round(kw * 0.25 * 1000.0, 9) AS energy_wh
FROM (SELECT event_id, try_cast("avgimportkw(kw)" AS DOUBLE) AS kw FROM quarter_hour)
WHERE kw IS NOT NULL""")
def _(v: Views):
    typed = v.quarter_hour.select("event_id", num.to_double(F.col("`avgimportkw(kw)`")).alias("kw"))
    return typed.dropna(subset=["kw"]).select(
        "event_id",
        F.round(num.kw_to_w("kw"), 9).alias("power_w"),
        F.round(num.quarter_hour_kw_to_wh("kw"), 9).alias("energy_wh"),
    )


@query("b18_day_first_parse", """
SELECT event_id, epoch_ms(strptime("Date" || ' ' || "Time", '%d/%m/%Y %H:%M:%S')) AS timestamp
FROM minute_rows""")
def _(v: Views):
    return v.minute_rows.select(
        "event_id", timecols.day_first_to_ms("Date", "Time").alias("timestamp")
    )


@query("b19_half_even_rounding", """
SELECT event_id, round_even(value / 4.0, 1) AS rounded FROM events""")
def _(v: Views):
    return v.table("events").select(
        "event_id", num.half_even(F.col("value") / 4.0, 1).alias("rounded")
    )


@query("b20_optional_filters", """
SELECT 'none' AS filter, * FROM anomalies
UNION ALL SELECT 'severity', * FROM anomalies WHERE severity = 'high'
UNION ALL SELECT 'both', * FROM anomalies WHERE severity = 'low' AND node_id = 'node_7'""")
def _(v: Views):
    def named(label, **filters):
        return serving.equals(v.anomalies, **filters).withColumn("filter", F.lit(label))

    return (
        named("none", severity="", node_id=None)
        .unionByName(named("severity", severity="high", node_id=""))
        .unionByName(named("both", severity="low", node_id="node_7"))
    )


@query("b21_hour_range", f"""
SELECT node_id, hour_ms, reading_count FROM hourly_rollup
WHERE hour_ms >= {JAN_16} AND hour_ms <= {JAN_29}""")
def _(v: Views):
    hourly = rollups.hourly_rollup(v.telemetry, v.metadata)
    rows = serving.hour_range(hourly, JAN_16, JAN_29)
    return rows.select("node_id", "hour_ms", "reading_count")


@query("b22_date_range", """
SELECT node_id, CAST(make_timestamp(day * 86400000000) AS DATE)::VARCHAR AS date, reading_count
FROM daily_rollup
WHERE CAST(make_timestamp(day * 86400000000) AS DATE)
  BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def _(v: Views):
    daily = rollups.daily_rollup(v.telemetry, v.metadata)
    rows = serving.date_range(daily, "2024-01-10", "2024-01-20")
    return rows.select("node_id", F.col("date").cast("string").alias("date"), "reading_count")


@query("b23_relative_time", f"""
SELECT 'last_6_h' AS span, event_id FROM telemetry WHERE timestamp >= {JAN_30 - 6 * 3600000}
UNION ALL SELECT 'next_24_h', event_id FROM telemetry
  WHERE timestamp >= {JAN_29} AND timestamp < {JAN_30}
UNION ALL SELECT 'last_30_d', event_id FROM telemetry
  WHERE timestamp >= {FEB_01 - 30 * 86400000}
UNION ALL SELECT 'last_11_h', event_id FROM telemetry
  WHERE timestamp >= {JAN_31 - 11 * 3600000}""")
def _(v: Views):
    spans = {
        "last_6_h": timecols.last_hours("timestamp", JAN_30, 6),
        "next_24_h": timecols.next_hours("timestamp", JAN_29, 24),
        "last_30_d": timecols.last_days("timestamp", FEB_01, 30),
        "last_11_h": timecols.last_hours("timestamp", JAN_31, 11),
    }
    marks = F.array_compact(
        F.array(*[F.when(condition, F.lit(name)) for name, condition in spans.items()])
    )
    return v.telemetry.select(F.explode(marks).alias("span"), "event_id")


@query("b24_arrival_interval", f"""
SELECT event_id, node_id, created_ms FROM telemetry
WHERE created_ms >= {JAN_16} AND created_ms < {JAN_29}""")
def _(v: Views):
    start, end = (F.timestamp_millis(F.lit(ms)) for ms in (JAN_16, JAN_29))
    return arrival_interval(v.telemetry, start, end).select(
        "event_id", "node_id", F.unix_millis("created_at").alias("created_ms")
    )


@query("b26_rfc3339", """
SELECT event_id, strftime(make_timestamp(timestamp // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS t
FROM telemetry""")
def _(v: Views):
    return v.telemetry.select("event_id", timecols.rfc3339_seconds("timestamp").alias("t"))


@query("b27_message_text", """
SELECT event_id, printf('%.0f', round_even(value, 0)) || 'W' AS watts,
       printf('%.3f', score) AS score,
       printf('%02d:00', hour(ts)) || ', ' || printf('%02d:00', 23 - hour(ts)) AS hours
FROM (SELECT *, ((event_id * 37) % 400 - 250) / CAST(1000 AS DOUBLE) AS score FROM events)""")
def _(v: Views):
    hour = timecols.utc_hour(timecols.ntz_to_ms("ts"))
    return v.table("events").select(
        "event_id",
        F.concat(text.fixed("value", 0), F.lit("W")).alias("watts"),
        text.fixed(F.expr("((event_id * 37) % 400 - 250) / 1000.0D"), 3).alias("score"),
        text.hour_list(F.array(hour, 23 - hour)).alias("hours"),
    )


@query("b28_field_pivot", "SELECT node_id, timestamp, voltage, current, power, energy_wh FROM telemetry")
def _(v: Views):
    return keyed.field_pivot(keyed.to_points(v.telemetry, MEASURES), MEASURES)


@query("b29_severity", "SELECT node_id, timestamp, score, severity FROM anomalies")
def _(v: Views):
    scored = v.anomalies.drop("severity").withColumn("severity", severity("score"))
    return scored.select("node_id", "timestamp", "score", "severity")


@query("b30_json_parse", """
SELECT event_id, try_cast(j ->> '$.timestamp' AS BIGINT) AS timestamp,
       CASE WHEN json_type(j, '$.current') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
            THEN try_cast(j ->> '$.current' AS DOUBLE) END AS current
FROM (SELECT event_id, try_cast(value AS JSON) AS j FROM messages)
WHERE j IS NOT NULL""")
def _(v: Views):
    judged = msg.judge_ingest(v.messages).where(F.col("reason").isNull() | (F.col("reason") != msg.BAD_JSON))
    return judged.select("event_id", "data.timestamp", "data.current")


@query("b31_live_feed", """
SELECT node_id, window_start, record_count FROM summaries""")
def _(v: Views):
    feed = live_feed(summary_messages(summarise(v.dense)).unionByName(v.messages.select("value")))
    back = F.from_json("value", TABLES["stream_summaries"])
    return feed.select(back.alias("s")).selectExpr(
        "s.node_id", "s.window_start", "CAST(s.record_count AS BIGINT) AS record_count"
    )


@query("b32_non_normal", "SELECT * FROM anomalies WHERE severity <> 'normal'")
def _(v: Views):
    return v.anomalies.where(is_anomalous())


@query("b33_reproducible_sample", """
SELECT event_id, node_id FROM telemetry
ORDER BY ('0x' || substr(md5('42:' || event_id), 1, 15))::BIGINT, event_id LIMIT 500""")
def _(v: Views):
    picked = ranked.reproducible_sample(v.telemetry, 500, ["event_id"])
    return picked.select("event_id", "node_id")


@query("c1_left_join_metadata", """
SELECT event_id, t.node_id, location AS division
FROM telemetry t LEFT JOIN metadata m ON t.node_id = m.node_id""")
def _(v: Views):
    joined = rollups.join_metadata(v.telemetry, v.metadata)
    return joined.select("event_id", "node_id", "division")


@query("c2_anti_join", f"""
SELECT DISTINCT node_id FROM forecasts f
WHERE timestamp >= {JAN_30} AND timestamp < {JAN_31}
AND NOT EXISTS (
  SELECT 1 FROM forecasts h WHERE h.node_id = f.node_id AND h.predicted_consumption >= 800
  AND h.timestamp >= {JAN_30} AND h.timestamp < {JAN_31})""")
def _(v: Views):
    ahead = recommend.upcoming_forecasts(v.forecasts, JAN_30)
    high = recommend.peak_per_node(ahead).select("node_id")
    return ahead.select("node_id").distinct().join(high, "node_id", "left_anti")


@query("c3_first_households", """
SELECT event_id, t.node_id, timestamp FROM telemetry t JOIN (
  SELECT node_id FROM telemetry GROUP BY node_id ORDER BY min(timestamp), node_id LIMIT 7) k
ON t.node_id = k.node_id""")
def _(v: Views):
    readings = v.telemetry.withColumnRenamed("timestamp", "timestamp_ms")
    kept = meters.first_households(readings, 7)
    return kept.select("event_id", "node_id", F.col("timestamp_ms").alias("timestamp"))


@query("c4_learning_gate", f"""
SELECT event_id, t.node_id FROM telemetry t JOIN (
  SELECT node_id, min(timestamp) AS first_ms FROM telemetry GROUP BY 1) s
ON t.node_id = s.node_id WHERE {FEB_01} - first_ms >= 2592000000""")
def _(v: Views):
    seen = nodes.first_seen(v.telemetry)
    return nodes.past_learning(v.telemetry, seen, FEB_01).select("event_id", "node_id")


@query("c5_anti_join_stored", f"""
SELECT event_id, node_id, timestamp FROM telemetry t WHERE NOT EXISTS (
  SELECT 1 FROM anomalies s WHERE s.node_id = t.node_id AND s.timestamp = t.timestamp
  AND s.severity <> 'normal')""")
def _(v: Views):
    stored = v.anomalies.where(is_anomalous()).select("node_id", "timestamp")
    fresh = v.telemetry.join(stored, ["node_id", "timestamp"], "left_anti")
    return fresh.select("event_id", "node_id", "timestamp")


@query("c6_forecast_vs_actual", f"""
SELECT f.node_id, f.timestamp, {r9_sql('predicted_consumption')}, round(a, 9) AS avg_power,
       round(predicted_consumption - a, 9) AS error
FROM forecasts f LEFT JOIN (
  SELECT node_id, timestamp // 3600000 * 3600000 AS h, avg(power) AS a FROM telemetry
  GROUP BY 1, 2) m ON f.node_id = m.node_id AND f.timestamp = h""")
def _(v: Views):
    out = forecasting.forecast_vs_actual(v.forecasts, hourly_features(v.telemetry))
    return out.select("node_id", "timestamp", *r9("predicted_consumption", "avg_power", "error"))
