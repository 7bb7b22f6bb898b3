"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from scripts.compare import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert differences(got, con.execute(ORACLES[name]).df()) is None


FAST_WITHOUT_SQL = ["compact_metrics", "embed_collection", "sample_n", "vector_knn_lsh"]


@pytest.mark.parametrize("name", FAST_WITHOUT_SQL)
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
