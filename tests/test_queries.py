"""Every query of the core against its SQL on the smallest tables; queries
without SQL must run and keep their schema."""

import pytest

from inkloom.plans import registry
from tests.oracle import connect, rows_of, sql_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["exact_text_copies"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(text)" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name", ["daily_heatmap", "shared_chapter_candidates", "keyword_search", "preference_weights"])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
