"""Rolling aggregates against Spark's own range windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.functions.timecols import DAY_MS
from wattloom.operators.rolling import Rolling, with_rolling

HOUR = 3_600_000
WANTED = [
    Rolling("avg_1", "avg", "value", 1),
    Rolling("avg_7", "avg", "value", 7),
    Rolling("avg_30", "avg", "value", 30),
    Rolling("min_1", "min", "value", 1),
    Rolling("max_7", "max", "value", 7),
    Rolling("std_7", "stddev", "value", 7),
]


def by_windows(frame):
    kinds = {"avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev}
    node = Window.partitionBy("node_id").orderBy("timestamp")
    return frame.withColumns(
        {
            w.name: kinds[w.kind](w.column).over(node.rangeBetween(-w.days * DAY_MS, 0))
            for w in WANTED
        }
    )


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def sample(spark, seed):
    """Gaps, equal times, nulls, times before 1970, a null node and a node with most rows."""
    rng = random.Random(seed)
    rows = []
    for node, n in ((None, 60), ("a", 1500), ("b", 40), ("c", 1)):
        at = -40 * DAY_MS
        for i in range(n):
            at += rng.choice((0, 1, 1, 1, 2, 30)) * HOUR
            value = rng.choice((None, 0.1, rng.gauss(50, 20), rng.gauss(50, 20)))
            rows.append((i, node, at, value))
    return spark.createDataFrame(rows, "n int, node_id string, timestamp bigint, value double")


@pytest.mark.parametrize("chunk_days, seed", [(90, 1), (1, 2), (7, 3)])
def test_equal_to_range_windows(spark, chunk_days, seed):
    frame = sample(spark, seed).repartition(5)
    got = rows_of(with_rolling(frame, WANTED, ["node_id"], chunk_days=chunk_days))
    want = rows_of(by_windows(frame))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4]
        for x, y in zip(a[4:], b[4:]):
            assert (x is None) == (y is None)
            assert x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9)


def test_constant_values_do_not_deviate(spark):
    rows = [(i, "a", i * HOUR, 1e9 + 0.1) for i in range(400)]
    frame = spark.createDataFrame(rows, "n int, node_id string, timestamp bigint, value double")
    got = with_rolling(frame, WANTED, ["node_id"]).orderBy("timestamp").collect()
    assert got[0]["std_7"] is None and {r["std_7"] for r in got[1:]} == {0.0}
    assert {r["avg_30"] for r in got} == {1e9 + 0.1}


def test_empty_and_lost_times(spark):
    schema = "n int, node_id string, timestamp bigint, value double"
    assert with_rolling(spark.createDataFrame([], schema), WANTED, ["node_id"]).count() == 0
    frame = spark.createDataFrame([(1, "a", None, 2.0), (2, "a", None, 4.0), (3, "a", 0, 9.0)], schema)
    got = {r["n"]: r["avg_1"] for r in with_rolling(frame, WANTED, ["node_id"]).collect()}
    assert got == {1: 3.0, 2: 3.0, 3: 9.0}
