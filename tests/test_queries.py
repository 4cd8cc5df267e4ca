"""Every query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences
from gateflow.catalog.oracles import all_oracles
from gateflow.catalog.queries import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert sorted(all_queries()) == sorted(all_oracles())
    assert set(all_queries()) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, connection, name):
    result = queries()[name](spark, FOLDER)
    assert differences(result, connection.sql(oracle_sql()[name])) is None


def test_entry_gives_a_curve_per_day(spark):
    result = entry(spark).toPandas()
    assert (result.groupby("fecha").size() == 24).all()
    assert result["fecha"].nunique() == 30


def test_comparison_notices_a_difference(spark, connection):
    nation = spark.read.parquet(f"{FOLDER}/nation.parquet")
    result = nation.selectExpr("CAST(n_nationkey + 1 AS INT) AS n_nationkey")
    expected = connection.sql("SELECT n_nationkey FROM nation")
    assert differences(result, expected) is not None
