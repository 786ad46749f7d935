import json

import pytest
from pyspark.sql import functions as F

from wattloom.functions import messages as msg

VALID = {
    "node_id": "node_001", "timestamp": 1714496400000, "voltage": 230.0,
    "current": 2.5, "power": 575.0, "energy_wh": 10.5,
}


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id INT, value STRING")


def changed(**changes):
    record = {**VALID, **changes}
    return json.dumps({k: v for k, v in record.items() if v is not ...})


INGEST = [
    (changed(), None),
    (changed(voltage=0), None),
    (changed(current=0), None),
    (changed(power=0), None),
    (changed(voltage=200), None),
    (changed(voltage=250), None),
    (changed(voltage=180), msg.VOLTAGE_RANGE),
    (changed(voltage=250.1), msg.VOLTAGE_RANGE),
    (changed(voltage="230"), "voltage must be a number"),
    (changed(voltage=True), "voltage must be a number"),
    (changed(voltage=None), "voltage must be a number"),
    (changed(voltage=...), msg.EXACT_FIELDS),
    (changed(extra=1), msg.EXACT_FIELDS),
    (changed(node_id=123), msg.NODE_TEXT),
    (changed(node_id="  "), msg.NODE_TEXT),
    (changed(timestamp="1714496400000"), msg.MS_INTEGER),
    (changed(timestamp=1714496400000.0), msg.MS_INTEGER),
    (changed(timestamp=123), msg.MS_DIGITS),
    (changed(current=-1), "current must be non-negative"),
    (changed(power=-1), "power must be non-negative"),
    (changed(energy_wh=-1), "energy_wh cannot be negative"),
    (changed(current=-1, power=-1), "current must be non-negative"),
    (changed(voltage={"voltage": 230}), "voltage must be a number"),
    ("{bad json", msg.BAD_JSON),
    ("", msg.BAD_JSON),
    ("[1, 2]", msg.EXACT_FIELDS),
    ("7", msg.EXACT_FIELDS),
    ("{}", msg.EXACT_FIELDS),
]


def test_ingest_rules(spark):
    rows = msg.judge_ingest(frame(spark, [v for v, _ in INGEST])).collect()
    got = {r["id"]: r["reason"] for r in rows}
    for i, (value, want) in enumerate(INGEST):
        assert got[i] == want, value


def broken(column, rule):
    return f"Validation failed for '{column}': {rule}"


WRONG = "expected correct type"
SUITE = [
    (changed(), msg.SUITE_OK),
    (changed(current=0, power=0), msg.SUITE_OK),
    (changed(voltage=199.9), msg.SUITE_OK),  # the suite allows 0 to 250
    (changed(voltage=250.1), broken("voltage", msg.RANGE_RULE)),
    (changed(voltage=None), msg.SUITE_OK),  # nulls pass the range rules
    (changed(voltage=True), broken("voltage", msg.TYPE_LIST_RULE)),
    (changed(voltage=...), broken("voltage", msg.TYPE_LIST_RULE)),
    (changed(unexpected="value"), broken("table", msg.TABLE_RULE)),
    (changed(node_id=123), broken("node_id", WRONG)),
    (changed(timestamp="1714496400000"), broken("timestamp", WRONG)),
    (changed(timestamp="x", node_id=1), broken("node_id", WRONG)),
    (changed(timestamp="x", voltage=300), broken("timestamp", WRONG)),
    (changed(timestamp=123), broken("timestamp", msg.RANGE_RULE)),
    (changed(current=-1), broken("current", msg.RANGE_RULE)),
    (changed(power=-1), broken("power", msg.RANGE_RULE)),
    (changed(energy_wh=-1), broken("energy_wh", msg.RANGE_RULE)),
    ("", msg.EMPTY),
    ("   ", msg.EMPTY),
    (None, msg.EMPTY),
    ("{bad json", msg.BAD_JSON),
]


def test_envelope(spark):
    rows = msg.envelope(frame(spark, [v for v, _ in SUITE])).collect()
    got = {r["id"]: r for r in rows}
    for i, (value, want) in enumerate(SUITE):
        assert got[i]["reason"] == want, value
        assert got[i]["status"] == ("valid" if want == msg.SUITE_OK else "invalid")
    assert got[0]["data"].asDict() == VALID
    assert got[16]["data"] is None and got[19]["data"] is None


def test_valid_records_unwrap(spark):
    rows = msg.valid_records(msg.envelope(frame(spark, [changed(), changed(power=-1)]))).collect()
    assert [r.asDict() for r in rows] == [VALID]


def test_messages_are_parsed_once(spark, folder):
    frame(spark, [changed()] * 3).write.parquet(folder + "/m")
    judged = msg.judge_ingest(spark.read.parquet(folder + "/m"))
    plan = judged.where(F.col("reason").isNull())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1


def test_typed_rules_agree_with_message_rules(spark):
    values = [v for v, want in INGEST if want not in (msg.EXACT_FIELDS, msg.BAD_JSON)]
    judged = msg.judge_ingest(frame(spark, values)).where("reason IS NULL OR reason LIKE '%between%' OR reason LIKE '%nega%'")
    typed = judged.select("reason", "data.*").withColumn("typed", msg.ingest_reason_typed())
    assert typed.where("NOT reason <=> typed").count() == 0


@pytest.mark.parametrize(
    "topic,want",
    [
        ("energy/nodes/n1/telemetry", "telemetry"),
        ("energy/nodes/n1/events", "events"),
        ("energy/nodes/n1/health", "health"),
        ("energy/nodes/n1/x/telemetry", None),
        ("energy/nodes/n1/other", None),
    ],
)
def test_route(spark, topic, want):
    assert spark.range(1).select(msg.route(F.lit(topic))).first()[0] == want


def test_has_fields(spark):
    full = json.dumps({f: 1 for f in msg.SUMMARY_FIELDS})
    rows = frame(spark, [full, '{"node_id": 1}', "oops", "[1]"])
    got = rows.orderBy("id").select(msg.has_fields("value", msg.SUMMARY_FIELDS)).collect()
    assert [r[0] for r in got] == [True, False, False, False]
