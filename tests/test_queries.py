"""Every registered query of the engine against its SQL in DuckDB, and the driver contract."""

from __future__ import annotations

import pytest
from oracle import SMALL
from oracle import expected, rows

import __spark_entry__ as entry
from rankyard.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    found = catalogue.queries()[name](spark, SMALL)
    columns, wanted = expected(SMALL, ORACLES[name])
    assert sorted(found.columns) == sorted(columns)
    assert rows((r.asDict(recursive=True) for r in found.collect()), columns) == rows(wanted, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).columns == ["query_id", "item_id", "score", "rank"]
