"""Every query with SQL against DuckDB on the smallest tables, and the entry query."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module

from .conftest import DATA

TABLES = ("documents", "pages", "labels", "embeddings", "conversations", "benchmark", "events", "orders", "lineitem", "customer", "supplier", "part", "nation", "region")


def values(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


CORE = [n for n in entry_module.registry.SQL]


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, duck, name):
    got, want = entry_module.queries()[name](spark, DATA).toPandas(), duck.sql(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_all_queries_have_sql():
    assert set(entry_module.registry.QUERIES) == set(entry_module.registry.SQL)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
