"""Epoch-millisecond time columns.

Bucketing and calendar fields use integer arithmetic on the millisecond value, so
results are UTC whatever the session time zone is, and the expressions stay inside
generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_MS = 1_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


def as_col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def floor_ms(ms: Column | str, width_ms: int) -> Column:
    """Start of the ``width_ms`` bucket holding ``ms``."""
    ms = as_col(ms)
    return ms - F.pmod(ms, F.lit(width_ms))


def hour_ms(ms: Column | str) -> Column:
    return floor_ms(ms, HOUR_MS)


def day_ms(ms: Column | str) -> Column:
    return floor_ms(ms, DAY_MS)


def epoch_day(ms: Column | str) -> Column:
    return F.floor(as_col(ms) / F.lit(DAY_MS)).cast("int")


def event_time(ms: Column | str) -> Column:
    """Timestamp with the sub-second part kept."""
    return F.timestamp_millis(as_col(ms))


def event_time_seconds(ms: Column | str) -> Column:
    """Timestamp truncated to whole seconds."""
    return F.timestamp_millis(floor_ms(ms, SECOND_MS))


def hour_start(ms: Column | str) -> Column:
    return F.timestamp_millis(hour_ms(ms))


def utc_date(ms: Column | str) -> Column:
    return F.date_from_unix_date(epoch_day(ms))


def utc_hour(ms: Column | str) -> Column:
    return F.floor(F.pmod(as_col(ms), F.lit(DAY_MS)) / F.lit(HOUR_MS)).cast("int")


def day_of_week_sunday1(ms: Column | str) -> Column:
    """1 = Sunday … 7 = Saturday. Epoch day 0 was a Thursday."""
    return (F.pmod(epoch_day(ms) + 4, F.lit(7)) + 1).cast("int")


def weekday_monday0(ms: Column | str) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.pmod(epoch_day(ms) + 3, F.lit(7)).cast("int")


def day_of_month(ms: Column | str) -> Column:
    return F.dayofmonth(utc_date(ms))


def rfc3339_seconds(ms: Column | str) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ``, zone-free."""
    ms = as_col(ms)
    seconds = F.floor(F.pmod(ms, F.lit(DAY_MS)) / F.lit(SECOND_MS)).cast("int")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(
        utc_date(ms).cast("string"),
        F.lit("T"),
        two(seconds / 3600),
        F.lit(":"),
        two(F.pmod(seconds, F.lit(3600)) / 60),
        F.lit(":"),
        two(F.pmod(seconds, F.lit(60))),
        F.lit("Z"),
    )


def ntz_to_ms(ts: str) -> Column:
    """Epoch milliseconds of a zone-less timestamp column read as UTC."""
    return F.expr(f"timestampdiff(MILLISECOND, {EPOCH_NTZ}, {ts})")


def day_first_to_ms(date: Column | str, time: Column | str) -> Column:
    """Epoch milliseconds of day-first date and time texts; NULL when unparsable."""
    # The texts carry no zone: with an explicit offset the session's zone plays no part.
    text = F.concat(as_col(date), F.lit(" "), as_col(time), F.lit(" +0000"))
    return F.unix_millis(F.try_to_timestamp(text, F.lit("d/M/yyyy H:mm:ss Z")))


def last_hours(ms: Column | str, as_of_ms: int, hours: int) -> Column:
    """At or after ``as_of_ms`` minus ``hours``."""
    return as_col(ms) >= F.lit(as_of_ms - hours * HOUR_MS)


def last_days(ms: Column | str, as_of_ms: int, days: int) -> Column:
    return as_col(ms) >= F.lit(as_of_ms - days * DAY_MS)


def next_hours(ms: Column | str, as_of_ms: int, hours: int) -> Column:
    """Half-open ``[as_of_ms, as_of_ms + hours)``."""
    ms = as_col(ms)
    return (ms >= F.lit(as_of_ms)) & (ms < F.lit(as_of_ms + hours * HOUR_MS))
