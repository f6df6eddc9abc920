"""The queries that SQL can express, on whole tables, against another engine."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from brindle.check import differences
from brindle.llm import queries as Q

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_equals_the_other_engine(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = c.sql(Q.ORACLE[name]), Q.QUERIES[name](spark, DATA)
    rows = want.fetchall()
    assert len(rows) > 100 and not differences(got.columns, [tuple(r) for r in got.collect()], want.columns, rows, absolute=1e-12, relative=1e-12)
