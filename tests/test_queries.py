"""Every registered query against its SQL in DuckDB, at a small scale."""

import os

import duckdb
import pytest

from evenkeel.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows_of(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else repr(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    got = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(got.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    if os.path.exists("/root/testdata/sf0.001"):
        assert e.entry(spark).count() == 6000
    assert set(e.oracle_sql()) <= set(e.queries())
