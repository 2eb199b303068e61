"""Every query of the rollout engine against DuckDB, or at least run."""

from __future__ import annotations

import pytest
from conftest import duck_rows, spark_rows

from tallyforge.plans import catalog

QUERIES, ORACLES = catalog.REGISTRY.queries, catalog.REGISTRY.oracles


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_duckdb(spark, data, name):
    df = QUERIES[name](spark, data)
    names, rows = duck_rows(ORACLES[name], data)
    assert sorted(df.columns) == names
    assert spark_rows(df) == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["uid", "hotkey", "weight"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
