"""The operators' queries against their SQL in DuckDB, over whole small tables."""

import pytest

from evenkeel.llm import queries
from tests.test_queries import con, rows_of  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):  # noqa: F811
    df = queries.queries()[name](spark, sf)
    got = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(got.fetchall(), columns)
