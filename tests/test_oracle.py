"""Every registered query against DuckDB SQL on the smallest data set, and the driver contract."""

from __future__ import annotations

import pytest
from oracle_check import connect, differences

import __spark_entry__ as contract
from conftest import SF_DIR
from goalweave.plans.oracle import oracle_sql
from goalweave.plans.queries import QUERIES

SQLS = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert differences(contract.queries()[name](spark, SF_DIR), duck, SQLS[name]) == []


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.count() > 0 and "goal_reached_month" in rows.columns


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQLS)
