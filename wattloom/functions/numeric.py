"""Numeric clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timecols import as_col


def to_double(column: Column | str) -> Column:
    """Text or number to DOUBLE; anything unparsable, and NaN, becomes NULL."""
    number = as_col(column).try_cast("double")
    return F.when(~F.isnan(number), number)


def clip(column: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Limit to ``[low, high]``; NULL stays NULL (``greatest`` alone would drop it)."""
    column = as_col(column)
    bounded = column
    if high is not None:
        bounded = F.least(F.lit(float(high)), bounded)
    if low is not None:
        bounded = F.greatest(F.lit(float(low)), bounded)
    return F.when(column.isNotNull(), bounded)


def half_even(column: Column | str, digits: int) -> Column:
    return F.bround(as_col(column), digits)


def is_active(power: Column | str = "power") -> Column:
    return F.when(as_col(power) > 0, 1).otherwise(0)


def kw_to_w(kw: Column | str) -> Column:
    """Kilowatt to watt, no negatives."""
    return clip(as_col(kw) * 1000.0, low=0.0)


def quarter_hour_kw_to_wh(kw: Column | str) -> Column:
    """Energy of a 15-minute interval; negatives are kept."""
    return as_col(kw) * 0.25 * 1000.0


def measured_or_derived_current(
    current: Column | str, power_w: Column | str, voltage: Column | str, factor: Column | str
) -> Column:
    """The measured value when positive, else P / (V * PF)."""
    current = as_col(current)
    derived = as_col(power_w) / (as_col(voltage) * as_col(factor) + 1e-9)
    return F.when(current.isNotNull() & (current > 0), current).otherwise(derived)
