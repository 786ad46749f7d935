"""Message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timecols import as_col


def fixed(column: Column | str, digits: int) -> Column:
    """Fixed-point text with half-even rounding.

    Java formatting rounds half up, so the value is rounded half even first.
    """
    return F.format_string(f"%.{digits}f", F.bround(as_col(column), digits))


def hour_list(hours: Column | str) -> Column:
    """``[7, 18]`` as ``07:00, 18:00``."""
    labels = F.transform(
        as_col(hours), lambda h: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))
    )
    return F.array_join(labels, ", ")
