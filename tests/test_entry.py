"""The driver contract on the smallest tables: queries against their SQL in DuckDB."""

import math
import os

import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
ORACLES = contract.oracle_sql()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple("nan" if isinstance(r[k], float) and math.isnan(r[k]) else r[k] for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["user_id", "slope", "p_value", "trend", "n"] and out.count() == 15


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())
