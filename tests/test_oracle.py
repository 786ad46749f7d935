"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    problem, _, rows = oracle.compare(spark, con, entry.queries()[name], SQL.get(name), SF)
    assert problem is None
    assert rows > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names_map_to_the_inventory():
    assert set(SQL) <= set(entry.queries())
    own = set(entry.queries()) - set(entry.EXTRA)
    assert all(name[0] in "abcdefghijkl" and name[1].isdigit() for name in own)


def test_results_do_not_depend_on_session_zone(spark, con):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in ("d1_hourly_rollup", "b7_calendar_fields", "b26_rfc3339", "b18_day_first_parse",
                     "l5_daily_analytics", "i4_window_summaries", "l10_feature_table"):
            problem, _, _ = oracle.compare(spark, con, entry.queries()[name], SQL[name], SF)
            assert problem is None, name
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
