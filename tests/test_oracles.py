"""Every registered query with a SQL twin agrees with it on the smallest tables."""

import os
import sys

import pytest

from tests.conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import compare, connect  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["type", "risk_level", "isFraud", "n"] and result.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    got = queries()[name](spark, SF).toArrow()
    assert len(got)
    assert compare(got, con.sql(ORACLES[name]).to_arrow_table()) == ""
