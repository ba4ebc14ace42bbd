"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry
from regionlens.plans.catalog import ORACLES, QUERIES
from tools.compare import canonical, oracle_connection


@pytest.fixture(scope="module")
def oracle(folder) -> duckdb.DuckDBPyConnection:
    return oracle_connection(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) == 94


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) > 0
    assert entry(spark).columns == ["zone", "mean_focus", "mean_share", "mean_per_1000"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, folder, oracle, name):
    import pandas as pd

    result = QUERIES[name](spark, folder)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("CartesianProduct", "NestedLoop", "Python") if word in plan]
    mine = result.toArrow()
    theirs = oracle.sql(ORACLES[name]).to_arrow_table()
    assert set(mine.column_names) == set(theirs.column_names)
    left = canonical(mine.to_pandas(types_mapper=pd.ArrowDtype))
    right = canonical(theirs.to_pandas(types_mapper=pd.ArrowDtype))
    assert left == right
