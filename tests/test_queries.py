"""Every query with SQL gives the rows of that SQL, in DuckDB, over the small tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans import base, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def sharing():
    base.SHARE = True
    yield
    base.SHARE = False


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    expected = duck.sql(registry.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(expected.columns)
    at = [expected.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())


def test_entry_has_rows(spark, sf):
    assert registry.QUERIES["gap_histogram"](spark, sf).count() == 7


def test_without_training_data_operators(monkeypatch):
    monkeypatch.setattr(entry, "training_data", None)
    assert set(entry.queries()) == set(registry.QUERIES) and entry.oracle_sql() == registry.SQL
