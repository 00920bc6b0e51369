"""Every music query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from notewright.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def ordered(frame):
    frame = frame[sorted(frame.columns)].astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    mine, theirs = ordered(registry.QUERIES[name](spark, DATA).toPandas()), ordered(duck.sql(registry.ORACLE_SQL[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert mine.equals(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_some_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
