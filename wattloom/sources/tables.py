"""Parquet tables partitioned by day.

Every file-based table here is partitioned by a date, so time filters prune partitions
and a re-run replaces only the days it recomputes (dynamic partition overwrite).
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import utc_date
from ..operators.keyed import insert_if_absent
from ..operators.retention import RETENTION_DAYS, expired, kept
from ..schemas import schema

DAY = "event_date"
BATCH = "batch"
# A batch that is stored by the day it arrived may be retried on a later day.
RETRY_DAYS = 7
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def with_day(frame: DataFrame, ms: str = "timestamp") -> DataFrame:
    return frame.withColumn(DAY, utc_date(ms))


def replace_days(frame: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write, replacing exactly the partitions present in ``frame``; safe to re-run.

    The rebalance groups rows by partition into files of the advisory size: small
    partitions share a task and AQE splits a large one, so neither many small files
    nor one huge task results.
    """
    layers = by or [DAY]
    (
        frame.hint("rebalance", *layers)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*layers)
        .parquet(path)
    )


def append_days(frame: DataFrame, path: str) -> None:
    frame.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def _file_system(spark: SparkSession, path: str):
    """Hadoop file system of a path, and a function from text to its path objects."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def day_folders(spark: SparkSession, path: str, span: tuple[date, date] | None = None) -> list[str]:
    """Folders of the stored days, by one listing of the table; with ``span`` only days in it, and
    the folder of rows without a day."""
    fs, to_path = _file_system(spark, path)
    if not fs.exists(to_path(path)):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(to_path(path))]
    days = [n for n in names if n.startswith(f"{DAY}=")]
    if span is not None:
        low, high = (d.isoformat() for d in span)
        days = [n for n in days if low <= n.split("=", 1)[1] <= high or n.endswith(NO_DAY)]
    return [f"{path}/{n}" for n in sorted(days)]


def read_days(
    spark: SparkSession,
    path: str,
    table: str,
    extra: list[str] | None = None,
    span: tuple[date, date] | None = None,
) -> DataFrame:
    """A day-partitioned table; empty with the declared schema when nothing is stored.

    ``extra`` names text columns besides the declared ones. With ``span`` only folders of those days
    are listed, which keeps a micro-batch from listing the files of the whole table.
    """
    fields = list(schema(table).fields)
    fields += [T.StructField(c, T.StringType()) for c in extra or []]
    fields.append(T.StructField(DAY, T.DateType()))
    declared = T.StructType(fields)
    folders = day_folders(spark, path, span)
    if not folders:
        return spark.createDataFrame([], declared)
    wanted = folders if span is not None else [path]
    return spark.read.schema(declared).option("basePath", path).parquet(*wanted)


def insert_rows(
    rows: DataFrame, path: str, table: str, keys: list[str], order: str, batch: str, time: str
) -> tuple[DataFrame, tuple[date, date] | None]:
    """Append the rows whose key is not stored yet; returns all stored rows of this batch, and the
    first and last day of the batch.

    Every row carries the name of its batch. A retried batch finds what it already stored, so it adds
    nothing twice and still returns all its rows. One aggregate gives the time span of the batch;
    folders outside its days are not listed, and files outside its times are not read.
    """
    spark = rows.sparkSession
    dated = with_day(rows, time)
    extra = [BATCH, *(k for k in keys if k not in schema(table).names and k != BATCH)]
    low, high, first, last = dated.agg(
        F.min(DAY), F.max(DAY), F.min(time), F.max(time)
    ).first()
    span = (low, high) if low is not None else None
    listed = (low - timedelta(days=RETRY_DAYS), high) if low is not None else (date.max, date.min)
    stored = read_days(spark, path, table, extra, listed)
    if BATCH in keys:  # only rows of this batch can be equal
        within = F.col(BATCH) == batch
    else:
        within = F.col(time).between(first, last)
    incoming = dated.withColumn(BATCH, F.lit(batch))
    new = insert_if_absent(incoming, stored.where(within), keys, order)
    new = new.drop(*([order] if order not in keys else []))
    append_days(new, path)
    mine = read_days(spark, path, table, extra, listed)
    return mine.where(F.col(BATCH) == batch), span


def compact_days(
    spark: SparkSession, path: str, span: tuple[date, date] | None = None, most_files: int = 16
) -> int:
    """Rewrite each day that has more than ``most_files`` files into files of the advisory size.

    A day is replaced only when its new files are complete, so a failed run changes nothing. The
    table's one writer calls this between its batches; readers that are at work on a day at that
    moment must read it again. Returns the number of days rewritten.
    """
    fs, to_path = _file_system(spark, path)
    full = []
    for folder in day_folders(spark, path, span):
        status = fs.listStatus(to_path(folder))
        files = [s for s in status if s.isFile() and s.getPath().getName().startswith("part-")]
        if len(files) > most_files:
            full.append(folder)
    if full:
        replace_days(spark.read.option("basePath", path).parquet(*full), path)
    return len(full)


def purge_rows(
    spark: SparkSession, path: str, table: str, as_of_ms: int, days: int = RETENTION_DAYS
) -> int:
    """Delete the expired rows of a stored table, by event time or by creation time; returns how many.

    Rows are counted per partition of the table (day, run or whatever it is partitioned by). Partitions
    without expired rows are not touched, those with nothing else go as folders, and the others are
    rewritten by a dynamic overwrite that replaces a partition after its new files are complete, so a
    lost executor or a re-run loses nothing.
    """
    fs, to_path = _file_system(spark, path)
    if not fs.exists(to_path(path)):
        return 0
    layers = _layers(fs, to_path, path)
    frame = spark.read.parquet(path)
    gone = F.coalesce(expired(table, as_of_ms, days), F.lit(False))
    counts = frame.groupBy(*layers).agg(
        F.count_if(gone).alias("deleted"), F.count(F.lit(1)).alias("total")
    )
    touched = counts.where("deleted > 0").collect()  # a row per partition with expired rows
    mixed = [r for r in touched if r["deleted"] < r["total"]]
    if mixed:
        # Folders of exactly these partitions; their survivors replace them.
        folders = [_folder(path, layers, r) for r in mixed]
        part = spark.read.option("basePath", path).parquet(*folders)
        replace_days(kept(part, table, as_of_ms, days), path, layers)
    for r in touched:
        if r["deleted"] == r["total"]:
            fs.delete(to_path(_folder(path, layers, r)), True)
    return sum(r["deleted"] for r in touched)


def _layers(fs, to_path, path: str) -> list[str]:
    """Partition columns of a table, by the names of its folders."""
    layers: list[str] = []
    while True:
        names = [s.getPath().getName() for s in fs.listStatus(to_path(path)) if s.isDirectory()]
        inner = next((n for n in sorted(names) if "=" in n), None)
        if inner is None:
            return layers
        layers.append(inner.split("=", 1)[0])
        path = f"{path}/{inner}"


def _folder(path: str, layers: list[str], row) -> str:
    names = (f"{c}={NO_DAY if row[c] is None else row[c]}" for c in layers)
    return "/".join([path, *names])
