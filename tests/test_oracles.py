"""Every query against its SQL, on the given tables."""

import compare
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, con, name):
    found = compare.spark_rows(driver.queries()[name](spark, SF))
    assert sum(found[2].values()) > 0
    if name in driver.oracle_sql():
        assert found == compare.sql_rows(con, driver.oracle_sql()[name])


def test_each_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


ORDERED = [
    "j2_asof_calibration",
    "j3_asof_game",
    "g3_turn_totals",
    "w2_detect_throws",
    "w4_running_score",
    "w5_cricket_marks",
    "w6_cricket_points",
    "e1_x01_states",
    "e2_cricket_standings",
]


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_over_large_sessions(spark, con, name):
    from ocheline.plans.ordered import LIMIT_SETTING

    # Some sessions are above the limit, some below.
    spark.conf.set(LIMIT_SETTING, "110")
    try:
        found = compare.spark_rows(driver.queries()[name](spark, SF))
    finally:
        spark.conf.unset(LIMIT_SETTING)
    assert found == compare.sql_rows(con, driver.oracle_sql()[name])


def test_compare_sees_a_difference(spark, con):
    found = compare.spark_rows(driver.queries()["m5_score"](spark, SF))
    wrong = driver.oracle_sql()["m5_score"].replace("SELECT CAST(event_id", "SELECT CAST(event_id + 1")
    assert found != compare.sql_rows(con, wrong)
