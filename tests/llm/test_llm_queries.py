"""The problems' queries: SQL where there is some, and that every one runs."""

import pytest

from docquarry.llm import queries
from tests.conftest import rows, sql_rows


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    columns, expected = sql_rows(duck, queries.SQL[name])
    assert sorted(df.columns) == columns
    assert rows(df) == expected


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_query_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).collect()
