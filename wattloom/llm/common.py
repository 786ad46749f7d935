"""Helpers shared by the operators: stored intermediates, Arrow slices, null defaults."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is
    unset as in local tests, a folder inside the warehouse, which is shared as well."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def stored_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    if not _KEPT:
        atexit.register(_delete_kept, spark)
    _KEPT.append(path)
    return path


def stored(frame: DataFrame) -> DataFrame:
    """Write once as Parquet into the shared folder and read that back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. The table is
    compressed and columnar, so later passes read only the columns they need. It is deleted when
    the driver's Python ends.
    """
    spark = frame.sparkSession
    path = stored_folder(spark)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


_KEPT: list[str] = []


def _delete_kept(spark: SparkSession) -> None:
    """Delete all stored tables when the driver's Python ends."""
    with contextlib.suppress(Exception):  # the session may be gone already
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _KEPT):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each action made inside as soon as it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(frame: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that no later plan reads."""
    spark = frame.sparkSession
    for file in frame.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("stored-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def utf8(column: str | Column) -> Column:
    """Text as UTF-8 bytes, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit("")).cast("binary")


def slices(
    batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of about ``most_bytes`` of one binary column.

    Keeps the Python objects alive at one time small; a longer single text is a run of its own.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        began = held = 0
        for i, size in enumerate(sizes):
            if held and held + (size or 0) > most_bytes:
                yield batch.slice(began, i - began)
                began, held = i, 0
            held += size or 0
        if began < len(sizes):
            yield batch.slice(began)


_STATE: dict[tuple, Any] = {}


def worker_state(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: one thing at a time, of one operator's run.

    A reused worker finds it again for the same ``key``; for another key it is made anew and the old
    one is given up, so the caches of operators that run one after the other do not add up.
    """
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]
