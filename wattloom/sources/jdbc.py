"""JDBC tables: bounded parallel scan, append, and overwrite that keeps the DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def connection(url: str, table: str, user: str, password: str, driver: str) -> dict[str, str]:
    return {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver}


def scan_options(
    options: dict[str, str], column: str, low: int, high: int, partitions: int
) -> dict[str, str]:
    """Split the scan into ranges of a numeric column; rows outside the bounds still
    come back, in the first and last range."""
    if partitions < 1 or high < low:
        raise ValueError("need at least one partition and low <= high")
    return {
        **options,
        "partitionColumn": column,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
    }


def read_table(
    spark: SparkSession,
    options: dict[str, str],
    low: int,
    high: int,
    partitions: int,
    column: str = "timestamp",
) -> DataFrame:
    """Parallel scan; selected columns and filters are pushed to the database."""
    ranged = scan_options(options, column, low, high, partitions)
    return spark.read.format("jdbc").options(**ranged).load()


def read_small_table(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Single-partition scan, for dimension tables without a numeric key."""
    return spark.read.format("jdbc").options(**options).load()


def append(frame: DataFrame, options: dict[str, str]) -> None:
    frame.write.format("jdbc").options(**options).mode("append").save()


def overwrite_options(options: dict[str, str]) -> dict[str, str]:
    """TRUNCATE instead of DROP and CREATE, so constraints survive."""
    return {**options, "truncate": "true"}


def overwrite(frame: DataFrame, options: dict[str, str]) -> None:
    (
        frame.write.format("jdbc").options(**overwrite_options(options))
        .mode("overwrite").save()
    )
