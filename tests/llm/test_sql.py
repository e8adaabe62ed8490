"""Queries with SQL against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from mnemospark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    r = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = sorted((dict(zip(names, x)) for x in r.fetchall()), key=str)
    got = queries.queries()[name](spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(([x[n] for n in names] for x in got.collect()), key=str) == sorted(([x[n] for n in names] for x in want), key=str)


def test_all_are_registered():
    have = entry.queries()
    for n in range(1, 11):
        assert len([q for q in have if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in have
