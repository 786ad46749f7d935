"""Raw JSON messages: typed parsing and the two rule sets that judge them.

Two named rule sets exist and differ on purpose:

* ingest rules: strict payload contract, voltage 0 or 200-250, nulls rejected;
* quality suite: expectation names, voltage 0-250, nulls pass the range rules.

A message is parsed once into a VARIANT. Integer, decimal, text, boolean and null
values stay distinguishable there, which ``from_json`` with a schema would lose.
Booleans are not numbers here, and ``NaN`` is not JSON.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MEASURES, READING_FIELDS
from .timecols import as_col

# Verdict texts and bounds.
MS_LOW, MS_HIGH = 1_000_000_000_000, 9_999_999_999_999
EXACT_FIELDS = "Telemetry record must contain exactly the required fields"
NODE_TEXT = "node_id must be a non-empty string"
MS_INTEGER = "timestamp must be an integer"
MS_DIGITS = "timestamp must be a 13-digit epoch in milliseconds"
VOLTAGE_RANGE = "voltage must be 0 (device off) or between 200 and 250"
INGEST_OK = "Valid telemetry message"
SUITE_OK = "Telemetry data is valid"
EMPTY = "Empty message"
BAD_JSON = "Invalid JSON"
NOT_NUMBER = {
    "voltage": "voltage must be a number",
    "current": "current must be a number",
    "power": "power must be a number",
    "energy_wh": "energy_wh must be a number",
}
BELOW_ZERO = {
    "current": "current must be non-negative",
    "power": "power must be non-negative",
    "energy_wh": "energy_wh cannot be negative",
}
TABLE_RULE = "expect_table_columns_to_match_set"
TYPE_RULE = "expect_column_values_to_be_of_type"
TYPE_LIST_RULE = "expect_column_values_to_be_in_type_list"
RANGE_RULE = "expect_column_values_to_be_between"

SUMMARY_FIELDS = [
    "node_id", "window_start", "window_end", "avg_power", "max_power", "record_count",
]


def parse(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``msg`` (VARIANT) and ``p``, a struct of facts about it.

    ``p`` holds the sorted ``fields``, and per required field its VARIANT type name
    (``type_*``) and typed value. A payload that is not an object has no fields.

    The one-element explodes keep the optimizer from copying the parse into every rule
    that reads it: without them a filter on the verdict parses each message many times.
    """
    whole = F.expr("try_variant_get(msg, '$', 'map<string,variant>')")
    parsed = messages.select(
        "*", F.explode(F.array(F.try_parse_json(F.col(value)))).alias("msg")
    ).select("*", F.explode(F.array(whole)).alias("_parts"))
    facts = F.struct(
        F.sort_array(F.map_keys("_parts")).alias("fields"),
        *[F.schema_of_variant(F.col("_parts")[f]).alias(f"type_{f}") for f in READING_FIELDS],
        _typed("node_id", "string"),
        _typed("timestamp", "bigint"),
        *[_typed(m, "double") for m in MEASURES],
    )
    return parsed.select("*", F.explode(F.array(facts)).alias("p")).drop("_parts")


def _typed(field: str, kind: str) -> Column:
    return F.expr(f"try_variant_get(_parts['{field}'], '$', '{kind}')").alias(field)


def _get(field: str) -> Column:
    return F.col(f"p.{field}")


def _type(field: str) -> Column:
    """VARIANT type name of a field, NULL when the field is absent."""
    return _get(f"type_{field}")


# VARIANT type names; a number with a decimal point or exponent is a DECIMAL or DOUBLE.
TEXT, INTEGER, NULL = "STRING", "BIGINT", "VOID"


def _numeric(field: str) -> Column:
    name = _type(field)
    return name.isin(INTEGER, "DOUBLE", "FLOAT") | name.startswith("DECIMAL")


def reading_struct() -> Column:
    """The six typed fields of a parsed message."""
    return F.struct(*[_get(f).alias(f) for f in READING_FIELDS])


def _is_not(condition: Column) -> Column:
    """True when the condition is false or unknown."""
    return ~F.coalesce(condition, F.lit(False))


def _first(*rules: tuple[Column, Column | str]) -> Column:
    """Text of the first broken rule, NULL when all hold."""
    return F.coalesce(*[F.when(broken, text) for broken, text in rules])


def ingest_reason_parsed() -> Column:
    """First broken ingest rule of a frame prepared by :func:`parse`."""
    exact = F.array(*[F.lit(f) for f in sorted(READING_FIELDS)])
    ms, volts = _get("timestamp"), _get("voltage")
    rules = [
        (_is_not(_get("fields") == exact), EXACT_FIELDS),
        (
            _is_not(_type("node_id") == TEXT)
            | _is_not(F.trim(_get("node_id")) != ""),
            NODE_TEXT,
        ),
        (_is_not(_type("timestamp") == INTEGER), MS_INTEGER),
        (_is_not(ms.between(MS_LOW, MS_HIGH)), MS_DIGITS),
        (_is_not(_numeric("voltage")), NOT_NUMBER["voltage"]),
        (_is_not((volts == 0) | volts.between(200, 250)), VOLTAGE_RANGE),
    ]
    for field, text in BELOW_ZERO.items():
        rules.append((_is_not(_numeric(field)), NOT_NUMBER[field]))
        rules.append((_is_not(_get(field) >= 0), text))
    return _first(*rules)


def ingest_reason_typed() -> Column:
    """First broken ingest rule of an already typed reading, NULL when valid."""
    rules = [
        (F.coalesce(F.trim("node_id"), F.lit("")) == "", NODE_TEXT),
        (F.col("timestamp").isNull(), MS_INTEGER),
        (~F.col("timestamp").between(MS_LOW, MS_HIGH), MS_DIGITS),
        (F.col("voltage").isNull(), NOT_NUMBER["voltage"]),
        (~((F.col("voltage") == 0) | F.col("voltage").between(200, 250)), VOLTAGE_RANGE),
    ]
    for field, text in BELOW_ZERO.items():
        rules.append((F.col(field).isNull(), NOT_NUMBER[field]))
        rules.append((F.col(field) < 0, text))
    return _first(*rules)


def suite_text(column: str, rule: str) -> str:
    return f"Validation failed for '{column}': {rule}"


def suite_reason_parsed() -> Column:
    """Verdict of the quality suite on one parsed message.

    Wrong text/integer types come first, then the rules in declared order. A field
    that is absent is reported under its own name; surplus fields under 'table'.
    """
    required = F.array(*[F.lit(f) for f in READING_FIELDS])
    fields = F.coalesce(_get("fields"), F.array().cast("array<string>"))
    wrong = {"node_id": TEXT, "timestamp": INTEGER}
    rules = [
        (_is_not(_type(f).isin(expected, NULL)), suite_text(f, "expected correct type"))
        for f, expected in wrong.items()
    ]
    rules += [(_type(m).isNull(), suite_text(m, TYPE_LIST_RULE)) for m in MEASURES]
    rules.append((F.size(F.array_except(fields, required)) > 0, suite_text("table", TABLE_RULE)))
    rules.append(
        (~_get("timestamp").between(MS_LOW, MS_HIGH), suite_text("timestamp", RANGE_RULE))
    )
    for m in MEASURES:
        value = _get(m)
        outside = (value < 0) | (value > 250) if m == "voltage" else value < 0
        rules.append((~(_numeric(m) | (_type(m) == NULL)), suite_text(m, TYPE_LIST_RULE)))
        rules.append((outside, suite_text(m, RANGE_RULE)))
    return _first(*rules)


def envelope(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``status``, ``reason`` and ``data`` (six typed fields) to each message."""
    blank = F.coalesce(F.trim(F.col(value)), F.lit("")) == ""
    reason = (
        F.when(blank, EMPTY)
        .when(F.col("msg").isNull(), BAD_JSON)
        .otherwise(F.coalesce(suite_reason_parsed(), F.lit(SUITE_OK)))
    )
    judged = parse(messages, value).withColumn("reason", reason)
    kept = [F.col(c) for c in messages.columns]
    return judged.select(
        *kept,
        F.when(F.col("reason") == SUITE_OK, "valid").otherwise("invalid").alias("status"),
        "reason",
        F.when(F.col("msg").isNotNull(), reading_struct()).alias("data"),
    )


def valid_records(judged: DataFrame) -> DataFrame:
    """Unwrap the payload of valid envelopes."""
    return judged.where(F.col("status") == "valid").select("data.*")


def judge_ingest(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``reason`` (NULL = valid) and ``data`` under the ingest rules."""
    judged = parse(messages, value)
    reason = F.when(F.col("msg").isNull(), BAD_JSON).otherwise(ingest_reason_parsed())
    kept = [F.col(c) for c in messages.columns]
    return judged.select(
        *kept,
        reason.alias("reason"),
        F.when(F.col("msg").isNotNull(), reading_struct()).alias("data"),
    )


def has_fields(value: Column | str, required: list[str]) -> Column:
    """True when the JSON object holds every required key."""
    keys = F.json_object_keys(as_col(value))
    wanted = F.array(*[F.lit(f) for f in required])
    return F.coalesce(F.size(F.array_except(wanted, keys)) == 0, F.lit(False))


def route(topic: Column | str) -> Column:
    """``telemetry``, ``events`` or ``health`` of a device topic; NULL otherwise."""
    topic = as_col(topic)
    options = ["telemetry", "events", "health"]
    return reduce(
        lambda chain, kind: chain.when(topic.rlike(f"^energy/nodes/[^/]+/{kind}$"), kind),
        options[1:],
        F.when(topic.rlike(f"^energy/nodes/[^/]+/{options[0]}$"), options[0]),
    )


def to_message(frame: DataFrame) -> DataFrame:
    """All columns as one JSON ``value`` per row."""
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("value"))
