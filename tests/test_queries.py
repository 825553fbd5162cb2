"""Every registered query of the grid engine against its SQL, and the driver's contract."""

import pytest

import __spark_entry__ as entry_module
from tests.conftest import DATA
from tests.helpers import connect, same_rows
from zonalis.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, con, name):
    mine, theirs = same_rows(catalogue.queries()[name](spark, DATA), con, catalogue.oracle_sql()[name])
    assert mine and mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_contract(spark):
    assert entry_module.entry(spark).count() == 15
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(catalogue.queries()) <= set(entry_module.queries())
