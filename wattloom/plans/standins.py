"""Domain tables derived from the given ``events``, ``customer`` and ``nation`` tables.

Each view uses every row of its source. ``VIEW_SQL`` states the same view for the
comparison engine. Expressions that read the same in both engines are written once.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.severity import severity
from ..functions.timecols import hour_ms, ntz_to_ms
from ..operators import features
from ..streaming.scoring import ANOMALY_TYPE

JAN_16 = 1_705_363_200_000
JAN_29 = 1_706_486_400_000
JAN_30 = 1_706_572_800_000
JAN_31 = 1_706_659_200_000
FEB_01 = 1_706_745_600_000

# Node of a reading; one in ten is unknown to the metadata.
NODE = "CASE WHEN user_id % 10 = 9 THEN 'meter_' ELSE 'node_' END || user_id"
# Measures of a reading; some are out of range on purpose.
VOLTAGE = (
    "CASE WHEN event_id % 97 = 0 THEN 0.0D WHEN event_id % 89 = 0 THEN 150.0D "
    "ELSE CAST(200 + event_id % 60 AS DOUBLE) END"
)
POWER = "CASE WHEN event_id % 101 = 0 THEN 0.0D - value ELSE value END"


def _text(field: str, value: str) -> str:
    return f"""'"{field}":' || CAST({value} AS STRING)"""


# A raw JSON message per reading, damaged in a dozen ways.
MESSAGE = f"""
CASE WHEN event_id % 53 = 0 THEN '  '
     WHEN event_id % 47 = 0 THEN '{{bad json'
     ELSE '{{' ||
       CASE WHEN event_id % 37 = 0 THEN '"node_id":12' WHEN event_id % 59 = 0 THEN '"node_id":" "'
            ELSE '"node_id":"' || node_id || '"' END || ',' ||
       CASE WHEN event_id % 31 = 0 THEN '"timestamp":"' || CAST(timestamp AS STRING) || '"'
            WHEN event_id % 29 = 0 THEN '"timestamp":1704067'
            ELSE '"timestamp":' || CAST(timestamp AS STRING) END ||
       CASE WHEN event_id % 43 = 0 THEN ''
            WHEN event_id % 23 = 0 THEN ',"voltage":"230"'
            ELSE ',"voltage":' || CAST(voltage AS STRING) END || ',' ||
       CASE WHEN event_id % 19 = 0 THEN '"current":-1' ELSE {_text('current', 'current')} END
       || ',' ||
       CASE WHEN event_id % 17 = 0 THEN '"power":null' ELSE {_text('power', 'power')} END || ',' ||
       CASE WHEN event_id % 13 = 0 THEN '"energy_wh":true'
            ELSE {_text('energy_wh', 'energy_wh')} END ||
       CASE WHEN event_id % 41 = 0 THEN ',"extra":1' ELSE '' END || '}}' END
"""
TOPIC = """
CASE WHEN event_id % 11 = 0 THEN 'energy/other/' || node_id
     WHEN event_type = 'error' THEN 'energy/nodes/' || node_id || '/events'
     WHEN event_type = 'signup' THEN 'energy/nodes/' || node_id || '/health'
     ELSE 'energy/nodes/' || node_id || '/telemetry' END
"""

# Raw text rows of the two external meter datasets.
QUARTER_HOUR = {
    "household_ID": "node_id",
    "timestamp": "CASE WHEN event_id % 50 = 0 THEN 'bad' ELSE CAST(timestamp AS STRING) END",
    "avgimportkw(kw)": (
        "CASE WHEN event_id % 61 = 0 THEN '' ELSE CAST(power / 100.0D AS STRING) END"
    ),
    "phaseainstvoltage(v)": (
        "CASE WHEN event_id % 59 = 0 THEN 'n/a' ELSE CAST(190 + event_id % 80 AS STRING) END"
    ),
    "phaseainstcurrent(a)": (
        "CASE WHEN event_id % 7 = 0 THEN '0' WHEN event_id % 11 = 0 THEN NULL "
        "ELSE CAST(power * 2.0D AS STRING) END"
    ),
    "powerfactor": (
        "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 10 = 0 THEN '1.7' "
        "WHEN event_id % 12 = 0 THEN '0.01' ELSE '0.95' END"
    ),
}
MINUTE = {
    "Date": (
        "CAST(day(ts) AS STRING) || '/' || CAST(month(ts) AS STRING) || '/' || "
        "CAST(year(ts) AS STRING)"
    ),
    "Time": (
        "CAST(hour(ts) AS STRING) || ':' || lpad(CAST(minute(ts) AS STRING), 2, '0') || ':' || "
        "lpad(CAST(CAST(second(ts) AS INT) AS STRING), 2, '0')"
    ),
    "Global_active_power": "CASE WHEN event_id % 33 = 0 THEN '?' ELSE CAST(value AS STRING) END",
    "Voltage": "CAST(200 + event_id % 60 AS STRING)",
    "Global_intensity": "CAST(event_id % 40 AS STRING)",
    "Sub_metering_1": "CAST(event_id % 3 AS STRING)",
    "Sub_metering_2": "CASE WHEN event_id % 71 = 0 THEN '?' ELSE CAST(event_id % 5 AS STRING) END",
    "Sub_metering_3": "CAST(event_id % 17 AS STRING)",
}


def _duck(expression: str) -> str:
    """Double literals carry no suffix in the comparison engine."""
    return re.sub(r"(\d+\.\d+)D", r"CAST(\1 AS DOUBLE)", expression)


def _duck_columns(columns: dict[str, str]) -> str:
    return ", ".join(f'{_duck(sql)} AS "{name}"' for name, sql in columns.items())


def _readings_sql(node: str) -> str:
    return f"""
SELECT event_id, event_type, {node} AS node_id, epoch_us(ts) // 1000 AS timestamp,
       {_duck(VOLTAGE)} AS voltage, value / 230.0 AS current, {_duck(POWER)} AS power,
       value * 0.25 AS energy_wh,
       epoch_us(ts) // 1000 + event_id % 5 * 86400000 AS created_ms
FROM events"""


SEVERITY_SQL = (
    "CASE WHEN score <= -0.15 THEN 'high' WHEN score <= -0.05 THEN 'medium' "
    "WHEN score <= 0 THEN 'low' ELSE 'normal' END"
)

VIEW_SQL = {
    "telemetry": _readings_sql(NODE),
    "dense": _readings_sql("event_type"),
    "metadata": """
SELECT 'node_' || c_custkey AS node_id, c_mktsegment AS node_type, n_name AS location
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "deliveries": """
SELECT node_id, timestamp, voltage, current, power, energy_wh,
       event_id * 2 + event_id % 2 AS seq FROM telemetry
UNION ALL
SELECT node_id, timestamp, voltage, current, power + 1, energy_wh,
       event_id * 2 + 1 - event_id % 2 AS seq FROM telemetry""",
    "anomalies": f"""
SELECT node_id, timestamp, '{ANOMALY_TYPE}' AS anomaly_type, score, {SEVERITY_SQL} AS severity
FROM (SELECT node_id, timestamp,
             ((event_id * 37) % 400 - 250) / CAST(1000 AS DOUBLE) AS score FROM telemetry)""",
    "forecasts": """
SELECT node_id, timestamp // 3600000 * 3600000 AS timestamp,
       max(power) * 10 AS predicted_consumption
FROM telemetry GROUP BY 1, 2""",
    "forecast_runs": """
SELECT node_id, timestamp, predicted_consumption, timestamp AS run_ts FROM forecasts
UNION ALL
SELECT node_id, timestamp, predicted_consumption * 3 + 1, timestamp - 3600000 FROM forecasts
UNION ALL
SELECT node_id, timestamp, predicted_consumption * 2, timestamp - 7200000 FROM forecasts
WHERE timestamp // 3600000 % 2 = 0""",
    "health": """
SELECT node_id, timestamp,
       CAST(timestamp // 3600000 - 473352 AS INTEGER) AS sequence_no FROM telemetry""",
    "runs": """
SELECT event_type || '_' || CAST(timestamp // 86400000 AS VARCHAR) AS run_id,
       CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'load-forecasting'
            ELSE 'anomaly-detection' END AS experiment,
       max(timestamp) AS ts, max(power) / CAST(1000 AS DOUBLE) AS test_mape,
       count(*) / CAST(10000 AS DOUBLE) AS anomaly_rate
FROM telemetry GROUP BY event_type, timestamp // 86400000""",
    "messages": f"""
SELECT event_id, {_duck(TOPIC)} AS topic, {_duck(MESSAGE)} AS value, event_id AS seq
FROM telemetry""",
    "quarter_hour": f"SELECT event_id, {_duck_columns(QUARTER_HOUR)} FROM telemetry",
    "minute_rows": f"SELECT event_id, {_duck_columns(MINUTE)} FROM events",
    "hourly": """
SELECT node_id, timestamp // 3600000 * 3600000 AS timestamp, avg(power) AS avg_power,
       avg(voltage) AS avg_voltage, avg(current) AS avg_current, min(power) AS min_power,
       max(power) AS max_power, stddev_samp(power) AS std_power, avg(energy_wh) AS avg_energy_wh,
       count(power) AS reading_count
FROM dense GROUP BY 1, 2""",
    "gappy": """
SELECT * REPLACE (CASE WHEN timestamp // 3600000 % 17 = 0 THEN NULL ELSE avg_power END AS avg_power)
FROM hourly""",
    "hourly_rollup": """
SELECT t.node_id, location AS division, timestamp // 3600000 * 3600000 AS hour_ms,
       sum(energy_wh) AS total_consumption_wh, avg(power) AS avg_power_w,
       max(power) AS peak_power_w, count(*) AS reading_count
FROM telemetry t LEFT JOIN metadata m ON t.node_id = m.node_id GROUP BY 1, 2, 3""",
    "daily_rollup": """
SELECT t.node_id, location AS division, timestamp // 86400000 AS day,
       sum(energy_wh) AS total_consumption_wh, avg(power) AS avg_power_w,
       max(power) AS peak_power_w, count(*) AS reading_count
FROM telemetry t LEFT JOIN metadata m ON t.node_id = m.node_id GROUP BY 1, 2, 3""",
    "summaries": """
SELECT node_id, timestamp // 2000 * 2000 AS window_start,
       timestamp // 2000 * 2000 + 2000 AS window_end, avg(power) AS avg_power,
       max(power) AS max_power, avg(voltage) AS avg_voltage, avg(current) AS avg_current,
       avg(energy_wh) AS avg_energy_wh, count(*) AS record_count
FROM dense GROUP BY 1, 2, 3""",
    "numbered": """
SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY timestamp) AS rn,
       count(*) OVER (PARTITION BY node_id) AS n FROM hourly""",
    "steady": f"""
SELECT * EXCLUDE (rn, n) REPLACE ({JAN_31} - (n - rn + 1) * 3600000 AS timestamp) FROM numbered""",
    "windows": """
SELECT * FROM (
  SELECT node_id, timestamp AS start_ms, rn, list(avg_power) OVER (
    PARTITION BY node_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 33 FOLLOWING) AS w
  FROM numbered) WHERE len(w) = 34""",
}


def with_views(sql: str) -> str:
    """Prefix a query with the views it uses, directly or through other views."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name in VIEW_SQL:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                pending.append(VIEW_SQL[name])
    ctes = [f"{name} AS ({body})" for name, body in VIEW_SQL.items() if name in needed]
    body = sql.strip()
    if not ctes:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[len('WITH RECURSIVE '):]}"
    if body.startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[len('WITH '):]}"
    return f"WITH {', '.join(ctes)} {body}"


class Views:
    """Spark side of the views, read from one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _readings(self, node: str) -> DataFrame:
        ms = ntz_to_ms("ts")
        return self.table("events").select(
            "event_id",
            "event_type",
            F.expr(node).alias("node_id"),
            ms.alias("timestamp"),
            F.expr(VOLTAGE).alias("voltage"),
            F.expr("value / 230.0D").alias("current"),
            F.expr(POWER).alias("power"),
            F.expr("value * 0.25D").alias("energy_wh"),
            F.timestamp_millis(ms + F.expr("event_id % 5 * 86400000")).alias("created_at"),
        )

    @cached_property
    def telemetry(self) -> DataFrame:
        return self._readings(NODE)

    @cached_property
    def dense(self) -> DataFrame:
        """Few nodes with nearly unbroken hours."""
        return self._readings("event_type")

    @cached_property
    def metadata(self) -> DataFrame:
        customers = self.table("customer")
        places = self.table("nation").select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("location")
        )
        return customers.join(places, "c_nationkey").select(
            F.expr("'node_' || c_custkey").alias("node_id"),
            F.col("c_mktsegment").alias("node_type"),
            "location",
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        """Every reading delivered twice with different power, in either order."""
        fields = ["node_id", "timestamp", "voltage", "current"]
        one = self.telemetry.selectExpr(
            *fields, "power", "energy_wh", "event_id * 2 + event_id % 2 AS seq"
        )
        two = self.telemetry.selectExpr(
            *fields, "power + 1 AS power", "energy_wh", "event_id * 2 + 1 - event_id % 2 AS seq"
        )
        return one.unionByName(two)

    @cached_property
    def anomalies(self) -> DataFrame:
        score = F.expr("((event_id * 37) % 400 - 250) / 1000.0D")
        return self.telemetry.select(
            "node_id", "timestamp", F.lit(ANOMALY_TYPE).alias("anomaly_type"), score.alias("score")
        ).withColumn("severity", severity("score"))

    @cached_property
    def forecasts(self) -> DataFrame:
        return self.telemetry.groupBy("node_id", hour_ms("timestamp").alias("timestamp")).agg(
            (F.max("power") * 10).alias("predicted_consumption")
        )

    @cached_property
    def forecast_runs(self) -> DataFrame:
        """Overlapping runs: up to three values per node and hour, of which the last counts."""
        run = lambda value, back: self.forecasts.selectExpr(
            "node_id", "timestamp", f"{value} AS predicted_consumption",
            f"timestamp - {back} AS run_ts",
        )
        older = run("predicted_consumption * 2", 7_200_000)
        return (
            run("predicted_consumption", 0)
            .unionByName(run("predicted_consumption * 3 + 1", 3_600_000))
            .unionByName(older.where("timestamp DIV 3600000 % 2 = 0"))
        )

    @cached_property
    def health(self) -> DataFrame:
        """Heartbeats whose counter is the hour since the start of the year."""
        return self.telemetry.selectExpr(
            "node_id", "timestamp", "CAST(timestamp DIV 3600000 - 473352 AS INT) AS sequence_no"
        )

    @cached_property
    def runs(self) -> DataFrame:
        experiment = F.when(
            F.col("event_type").isin("click", "view", "signup"), "load-forecasting"
        ).otherwise("anomaly-detection")
        day = F.expr("timestamp DIV 86400000").alias("day")
        daily = self.telemetry.groupBy("event_type", day).agg(
            F.max("timestamp").alias("ts"),
            (F.max("power") / F.lit(1000.0)).alias("test_mape"),
            (F.count(F.lit(1)) / F.lit(10000.0)).alias("anomaly_rate"),
        )
        return daily.select(
            F.expr("event_type || '_' || day").alias("run_id"),
            experiment.alias("experiment"),
            "ts",
            F.create_map().cast("map<string,string>").alias("params"),
            F.create_map(
                F.lit("test_mape"), "test_mape", F.lit("anomaly_rate"), "anomaly_rate"
            ).alias("metrics"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.telemetry.select(
            "event_id",
            F.expr(TOPIC).alias("topic"),
            F.expr(MESSAGE).alias("value"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def quarter_hour(self) -> DataFrame:
        columns = [F.expr(sql).alias(name) for name, sql in QUARTER_HOUR.items()]
        return self.telemetry.select("event_id", *columns)

    @cached_property
    def minute_rows(self) -> DataFrame:
        columns = [F.expr(sql).alias(name) for name, sql in MINUTE.items()]
        return self.table("events").select("event_id", *columns)

    @cached_property
    def hourly(self) -> DataFrame:
        return features.hourly_features(self.dense)

    @cached_property
    def steady(self) -> DataFrame:
        """The same hours without gaps, up to the end of January 30."""
        back = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("timestamp")))
        return self.hourly.withColumn("timestamp", F.lit(JAN_31) - back.cast("bigint") * 3_600_000)

    @cached_property
    def gappy(self) -> DataFrame:
        """Hours of which some have no average."""
        known = F.expr("timestamp DIV 3600000 % 17 <> 0")
        return self.hourly.withColumn("avg_power", F.when(known, F.col("avg_power")))
