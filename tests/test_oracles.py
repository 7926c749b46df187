"""Every query with SQL gives the rows that its SQL gives on the same tables; every other query of the library runs."""

from __future__ import annotations

import pytest

from inkwell import catalogue
from oracle import difference


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_its_sql(spark, small, name):
    assert difference(catalogue.QUERIES[name](spark, small), catalogue.ORACLES[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
