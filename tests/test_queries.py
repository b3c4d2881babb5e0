"""Every query with SQL gives the rows of its SQL; every query runs."""

import pytest

from docquarry import queries
from tests.conftest import rows, sql_rows

SLOW = {"search", "pagerank", "ndcg", "prf_rank"}


@pytest.mark.parametrize("name", [n for n in queries.SQL if n not in SLOW])
def test_query_equals_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    columns, expected = sql_rows(duck, queries.SQL[name])
    assert sorted(df.columns) == columns
    assert rows(df) == expected


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL and n not in SLOW])
def test_query_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).collect()


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
