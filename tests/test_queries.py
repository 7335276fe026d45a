"""Every query with SQL gives DuckDB's rows over the driver's smallest tables."""

import math

import duckdb
import pytest

from tessella import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def rows(table):
    columns = sorted(table.column_names)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_agrees_with_duckdb(spark, duck, sf, name):
    want = duck.sql(core.ORACLES[name]).arrow()
    want = want if hasattr(want, "to_pylist") else want.read_all()
    assert rows(core.QUERIES[name](spark, sf).toArrow()) == rows(want)


def test_entry_runs_and_names_are_distinct(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
