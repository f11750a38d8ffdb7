"""Every registered query of the search engine against its SQL, on a small table set."""

import os

import duckdb
import pytest

from quillspark.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda v: repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def test_every_query_is_listed():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["analyze_word_delimiter", "analyze_standard", "analyze_whitespace"])
def test_counting_words_takes_tasks_as_the_text_grows(spark, monkeypatch, name):
    """An id's words are counted in the task that cuts them, of a bounded share of the text; none holds a file's."""
    import re

    from quillspark import queries

    one = QUERIES[name](spark, DATA)
    monkeypatch.setattr(queries, "TASK_SIGNS", 100, raising=False)
    many = QUERIES[name](spark, DATA)
    dealt = [re.findall(r"hashpartitioning\((.*?)#?\d*L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()) for df in (one, many)]
    assert [len(x) for x in dealt] == [1, 1] and int(dealt[1][0][1]) > 4 * int(dealt[0][0][1])
    assert sorted(one.collect()) == sorted(many.collect())
