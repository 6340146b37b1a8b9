"""Every query with an SQL form gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from framequery.plans.catalog import ORACLES, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(row: tuple) -> tuple:
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


def order(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((rounded(tuple(r[c] for c in columns)) for r in df.collect()), key=order)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((rounded(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall()), key=order)
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_catalog_query_is_offered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
