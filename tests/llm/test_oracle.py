"""Queries with SQL against DuckDB, by value."""

import os

import duckdb
import pytest

from nearfield.llm.queries import ORACLE_SQL, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows_as_duckdb(spark, name):
    duck = duckdb.connect()
    for t in os.listdir(SF):
        duck.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = QUERIES[name](spark, SF)
    ours = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert ours == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=str)
