"""Every named query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as contract
from conftest import plan_of
from parity import compare
from plaudit.plans.registry import ORACLES, QUERIES


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("ArrowEvalPython" in plan) == (name in ("stem_tokens", "review_tokens"))
    assert compare(df, duck, ORACLES[name]) == []


def test_entry_gives_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["Brand_name", "n", "share"]
    assert df.count() > 0
