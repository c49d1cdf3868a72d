"""Every registered query against its SQL in DuckDB on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry_module
from tools.check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, key):
    df = QUERIES[key](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    if key in ORACLES:
        problem, _ = compare(df, connect(FOLDER), ORACLES[key])
        assert not problem, problem
    else:
        assert df.count() >= 0


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["id", "members", "deepest_level"] and df.count() > 0
