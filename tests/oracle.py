"""Compare registered queries with their SQL on the given tables.

Usage: ``python tests/oracle.py [sf folder] [name ...]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float) and math.isnan(value):
            return "NaN"
        return repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, run, sql, sf_dir):
    """(difference or None, seconds of Spark, rows)"""
    began = time.time()
    frame = run(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    spent = time.time() - began
    if sql is None:
        return None, spent, len(got)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", spent, len(got)
    a, b = canonical(frame.columns, got), canonical(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}", spent, len(got)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}", spent, len(got)
    return None, spent, len(got)


def main() -> int:
    import __spark_entry__ as entry
    from wattloom.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    sql = entry.oracle_sql()
    for name, run in entry.queries().items():
        if args and name not in args:
            continue
        try:
            problem, spent, rows = compare(spark, con, run, sql.get(name), sf_dir)
        except Exception as error:  # report and go on
            problem, spent, rows = f"{type(error).__name__}: {str(error)[:600]}", 0.0, -1
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        kind = "" if name in sql else " (no SQL)"
        print(f"{mark} {name}{kind} rows={rows} {spent:.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
