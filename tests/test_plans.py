"""Every registered plan with a statement gives the same rows on Spark and on DuckDB."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()
STATEMENTS = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_plan_matches_statement(spark, sql, name):
    rows = QUERIES[name](spark, SF_DIR).toPandas()
    assert differences(rows, sql.execute(STATEMENTS[name]).df()) == []


def test_every_statement_belongs_to_a_query():
    assert set(STATEMENTS) <= set(QUERIES)


def test_entry_returns_rows(spark):
    rows = entry_point.entry(spark)
    assert rows.columns[0] == "cohort_id"
    assert rows.count() > 0
