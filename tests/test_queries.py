"""Every registered query against its SQL twin on the smallest data folder."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["lang", "pii_type", "n", "docs"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    if name in ORACLES:
        assert compare(spark, sf_dir, QUERIES[name], ORACLES[name], con, allow_empty=True) is None
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0
