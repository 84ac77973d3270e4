"""Every query against its SQL on the smallest tables, and the driver's contract."""

import re

import pytest

import __spark_entry__ as entry
from blobloom import queries

from .compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_predictions_of_large_tables_stay_in_place(spark, monkeypatch):
    """Where a table is too large to be dealt out, its pixels are neither shuffled nor sorted: a row a pixel is many times the input on disk."""
    monkeypatch.setattr(queries.lineage, "dealt", lambda df, *keys, **bounds: df)
    plan = queries.queries()["paeth_prediction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan and not re.search("Exchange|Sort|Window", plan)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
