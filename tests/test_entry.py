import os

import pytest

import __spark_entry__ as entry


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and {f"q{i:02d}" for i in range(1, 23)} <= set(oracle)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
