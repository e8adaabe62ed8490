"""The registered queries against DuckDB, as the driver compares them."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from mnemospark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) or hasattr(v, "to_eng_string"):
        return round(float(v), 6) + 0.0 if not math.isnan(float(v)) else "nan"
    return v


def rows(columns, table):
    return sorted((tuple(plain(r[c]) for c in columns) for r in table), key=str)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "dist", "score"] and df.count() == 10


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, db, name):
    got = catalog.queries()[name](spark, sf)
    r = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(got.columns)
    want = [dict(zip(names, x)) for x in r.fetchall()]
    columns = sorted(names)
    assert rows(columns, [x.asDict() for x in got.collect()]) == rows(columns, want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
