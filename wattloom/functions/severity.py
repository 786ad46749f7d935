"""Severity bands of an anomaly score (lower is more anomalous)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timecols import as_col

# Upper bound of each band.
HIGH = -0.15
MEDIUM = -0.05
LOW = 0.0


def severity(score: Column | str) -> Column:
    """Band of the unrounded score."""
    score = as_col(score)
    return (
        F.when(score <= HIGH, "high")
        .when(score <= MEDIUM, "medium")
        .when(score <= LOW, "low")
        .otherwise("normal")
    )


def is_anomalous(column: Column | str = "severity") -> Column:
    return as_col(column) != "normal"
