"""Every query of the catalog against its SQL twin, on the given tables."""

import pytest

import __spark_entry__ as entry
from pairloom.plans.catalog import QUERIES
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.01"
TWINS = {name: query.sql for name, query in QUERIES.items() if query.sql is not None}

#: Queries that SQL cannot express; each has a test of its own.
WITHOUT_TWIN = {"reward_on_quality"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", TWINS)
def test_query_equals_its_twin(spark, con, name):
    assert difference(spark, con, FOLDER, QUERIES[name].run, TWINS[name]) is None


def test_flagship_has_rows(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["config", "split", "n"]
    assert rows.count() > 0


def test_every_query_has_a_twin_or_says_so():
    assert set(QUERIES) - set(TWINS) == WITHOUT_TWIN


def test_the_entry_registers_the_catalog():
    assert set(QUERIES) <= set(entry.queries())
    assert set(TWINS) <= set(entry.oracle_sql()) <= set(entry.queries())
