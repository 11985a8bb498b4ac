"""Every named query against its SQL form on the small tables; those without SQL return rows."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()

# Parameters made for larger tables: nothing qualifies on the smallest ones.
EMPTY_ON_SMALL = {"advanced_search", "advanced_search_snapshot"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, FOLDER)
    if name not in SQL:
        assert result.count() > 0
        return
    problems = compare(result, con, SQL[name])
    if name in EMPTY_ON_SMALL:
        problems = [p for p in problems if p != "no rows"]
    assert problems == []


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.count() > 0
    assert {"query_id", "id", "score", "retrieval_method"} <= set(result.columns)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
