"""What the plans must and must not contain."""

import re

import pytest

from gateflow.catalog import queries as catalog
from gateflow.catalog.adapter import transactions
from gateflow.operators import calendar, counts, joins
from gateflow.plans import flow

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    """The plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def run_plan(df):
    """The plan as it ran."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_gate_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "tx")
    transactions(spark, FOLDER).write.parquet(path)
    counted = (
        spark.read.parquet(path)
        .transform(counts.keep_gates)
        .transform(counts.count_hourly)
    )
    text = plan(counted)
    assert re.search(r"PushedFilters: \[In\(tema_key", text)
    (schema,) = set(re.findall(r"ReadSchema: struct<(.*?)>", text))
    assert [c.split(":")[0] for c in schema.split(",")] == [
        "tema_key",
        "transaction_date",
        "transit_direction_description",
    ]


@pytest.mark.parametrize("name", sorted(catalog.all_queries()))
def test_no_cross_join_anywhere(spark, name):
    text = plan(catalog.all_queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_flow_starts_from_the_stored_counts(spark):
    text = plan(flow.occupancy(transactions(spark, FOLDER)))
    assert "FileScan" not in text
    assert "Scan ExistingRDD" in text


def test_one_placement_serves_sum_running_count_and_pivot(spark):
    stored = catalog.stored_hourly(spark, FOLDER)
    dense = calendar.dense_table(stored)
    levels = catalog.reshape.pivot_hours(dense, "conteo_acumulado")
    text = plan(levels)
    assert text.count("REPARTITION_BY_COL") == 1
    above = text.split("REPARTITION_BY_COL")[0]
    assert above.count("Exchange") == 1


def test_boxes_reuse_the_frequencies(spark):
    text = run_plan(catalog.all_queries()["op_boxplot_stats"](spark, FOLDER))
    assert "ReusedExchange" in text


def test_large_lookup_is_not_broadcast_by_hint(spark):
    lookup = spark.range(50).selectExpr("CAST(id AS STRING) AS gate")
    rows = spark.range(100).selectExpr("CAST(id % 60 AS STRING) AS tema_key")
    assert joins.measured_bytes(lookup) == 50 * 16 + 10 * 1 + 40 * 2
    for limit, hinted in ((1000, True), (100, False)):
        side = joins.broadcast_if_small(lookup, limit)
        joined = rows.join(side.withColumnRenamed("gate", "tema_key"), "tema_key", "left_semi")
        logical = joined._jdf.queryExecution().analyzed().toString()
        assert ("ResolvedHint" in logical) is hinted
        assert joined.count() == 90
