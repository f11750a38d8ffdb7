"""The native operators' registered queries against their SQL."""

import os

import duckdb
import pytest

from quillspark.llm.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = QUERIES[name](spark, DATA), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = lambda columns, values: sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in values)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
