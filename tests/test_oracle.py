"""Every registered query beside its oracle; the comparison also refuses all-pairs joins."""

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_names_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    problem, _ = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None


def test_scan_pushes_filter_and_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = QUERIES["scan_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(l_returnflag,R)" in plan and "GreaterThanOrEqual(l_shipdate" in plan
    assert "l_extendedprice" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
