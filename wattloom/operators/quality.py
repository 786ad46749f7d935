"""Batch quality checks of stored readings.

The suite is a list of column rules evaluated as expressions in one pass. Schema rules
(column set, types) are settled from the DataFrame schema before any data is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.messages import (
    MS_HIGH, MS_LOW, RANGE_RULE, TABLE_RULE, TYPE_LIST_RULE, TYPE_RULE, suite_text,
)
from ..schemas import MEASURES, READING_FIELDS

TABLE_FAILURE = "Telemetry validation failed"


def suite() -> list[tuple[str, str]]:
    """The twelve rules in declared order, as ``(column, expectation)``."""
    rules = [
        ("table", TABLE_RULE),
        ("node_id", TYPE_RULE),
        ("timestamp", TYPE_RULE),
        ("timestamp", RANGE_RULE),
    ]
    for measure in MEASURES:
        rules += [(measure, TYPE_LIST_RULE), (measure, RANGE_RULE)]
    return rules


def schema_failures(schema: T.StructType) -> list[tuple[str, str]]:
    """Schema rules broken by a frame."""
    types = {f.name: f.dataType for f in schema.fields}
    broken = []
    if set(types) != set(READING_FIELDS):
        broken.append(("table", TABLE_RULE))
    if not isinstance(types.get("node_id"), T.StringType):
        broken.append(("node_id", TYPE_RULE))
    if not isinstance(types.get("timestamp"), T.LongType):
        broken.append(("timestamp", TYPE_RULE))
    for measure in MEASURES:
        if not isinstance(types.get(measure), (T.LongType, T.DoubleType)):
            broken.append((measure, TYPE_LIST_RULE))
    return broken


def in_range(column: str) -> Column:
    """Range rule of a column; NULL passes."""
    value = F.col(column)
    bounds = {"timestamp": (MS_LOW, MS_HIGH), "voltage": (0, 250)}
    low, high = bounds.get(column, (0, None))
    ok = value >= low if high is None else value.between(low, high)
    return F.coalesce(ok, F.lit(True))


def _ranged(frame: DataFrame) -> list[str]:
    return [c for c in ["timestamp", *MEASURES] if c in frame.columns]


def expectation_results(readings: DataFrame) -> DataFrame:
    """One row per rule: ``position``, ``column_name``, ``expectation``, ``unexpected``,
    ``success``. Row rules are counted together in a single aggregate."""
    broken = set(schema_failures(readings.schema))
    counted = readings.agg(
        *[F.count_if(~in_range(c)).alias(c) for c in _ranged(readings)]
    )
    rows = []
    for position, (column, rule) in enumerate(suite(), start=1):
        if rule == RANGE_RULE:
            present = column in readings.columns
            unexpected = F.col(column) if present else F.lit(None).cast("bigint")
            success = (unexpected == 0) if present else F.lit(False)
        else:
            unexpected = F.lit(None).cast("bigint")
            success = F.lit((column, rule) not in broken)
        rows.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(column).alias("column_name"),
                F.lit(rule).alias("expectation"),
                unexpected.alias("unexpected"),
                success.alias("success"),
            )
        )
    return counted.select(F.inline(F.array(*rows)))


def with_verdict(readings: DataFrame) -> DataFrame:
    """Add ``reason``: the first broken rule of each row, NULL when it passes.

    When no row breaks a row rule but the schema does, every row fails.
    """
    rules = [F.when(~in_range(c), suite_text(c, RANGE_RULE)) for c in _ranged(readings)]
    reason = F.coalesce(*rules, F.lit(None).cast("string"))
    if schema_failures(readings.schema):
        broken_rows = readings.agg(F.count_if(reason.isNotNull())).scalar()
        reason = F.when(broken_rows == 0, TABLE_FAILURE).otherwise(reason)
    return readings.withColumn("reason", reason)


def failures(readings: DataFrame) -> DataFrame:
    """The failing rows, as a frame; nothing is gathered on the driver."""
    return (
        with_verdict(readings)
        .where(F.col("reason").isNotNull())
        .select("node_id", "timestamp", "reason")
    )


def validation_summary(readings: DataFrame, start: str, end: str) -> DataFrame:
    """Checked, passed and failed counts of one interval."""
    failed = F.count_if(F.col("reason").isNotNull())
    checked = F.count(F.lit(1))
    return with_verdict(readings).agg(
        F.lit(start).alias("start_time"),
        F.lit(end).alias("end_time"),
        checked.alias("checked"),
        (checked - failed).alias("passed"),
        failed.alias("failed"),
    )


def failure_counts(readings: DataFrame) -> DataFrame:
    """Failing rows per reason."""
    return failures(readings).groupBy("reason").agg(F.count(F.lit(1)).alias("failed"))


def arrival_interval(readings: DataFrame, start: Column, end: Column) -> DataFrame:
    """Readings created in ``[start, end)``."""
    return readings.where((F.col("created_at") >= start) & (F.col("created_at") < end))
