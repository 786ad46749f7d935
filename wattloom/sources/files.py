"""File readers. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.meters import MINUTE_COLUMNS, QUARTER_HOUR_COLUMNS
from ..schemas import READING, schema



def read_quarter_hour_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """15-minute meter files as text columns; surplus columns are pruned by the reader.

    Columns are matched by header name, so files may order them differently.
    """
    frames = spark.read.option("header", True).option("inferSchema", False)
    wanted = [f"`{c}`" for c in QUARTER_HOUR_COLUMNS]
    parts = [frames.csv(p).select(*wanted) for p in paths]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def read_minute_text(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated per-minute household text with ``?`` for missing values."""
    return (
        spark.read.option("sep", ";").option("header", True).option("nullValue", "?")
        .csv(path).select(*MINUTE_COLUMNS)
    )


def read_reading_array(spark: SparkSession, path: str) -> DataFrame:
    """Readings stored as one JSON array per file."""
    return spark.read.schema(READING).option("multiLine", True).json(path)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored Parquet table under its declared schema."""
    return spark.read.schema(schema(table)).parquet(path)


def export_snapshot(frame: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Training snapshot (Parquet, or CSV with a header)."""
    frame.write.mode("overwrite").option("header", True).format(fmt).save(path)
