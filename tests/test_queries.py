"""Every registered query beside its SQL on DuckDB."""

import os

import pytest
from compare import TESTDATA, duck, duck_rows, spark_rows

from loomtext.suite import ORACLES, QUERIES

FOLDER = f"{TESTDATA}/sf{os.environ.get('TEST_SF', '0.001')}"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(tables, connection, name):
    columns, rows = spark_rows(QUERIES[name](tables))
    if name in ORACLES:
        assert (columns, rows) == duck_rows(connection, ORACLES[name])
    assert rows


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["ctx_id", "n_chunks", "answer"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
