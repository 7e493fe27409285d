"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

from suite.all_queries import ORACLES, QUERIES
from suite.check import compare, connect
from suite.plans import FORBIDDEN, final_plan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) in ("", "EMPTY")
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["A2_version_diff", "D1_before_after", "D3_exact_renames", "E9_scan_summary", "I6_share"])
def test_plans_hold_no_cross_join(spark, name):
    plan = final_plan(QUERIES[name](spark, SF))
    assert not [f for f in FORBIDDEN if f in plan]


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
