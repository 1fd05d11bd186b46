"""Every registered query against its SQL counterpart on the smallest data."""

import __spark_entry__ as entry
import pytest
from compare import compare, connect
from kinfold.catalog.oracles import oracle_sql
from kinfold.catalog.queries import queries

FOLDER = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, FOLDER), con, ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(queries()) <= set(entry.queries())


def test_entry_runs(spark):
    assert sum(r.n_messages for r in entry.entry(spark).collect()) == 200
