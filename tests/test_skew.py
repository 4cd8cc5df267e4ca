"""One source, gate or hour holds a third of all rows or more."""

from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from gateflow.operators import joins
from gateflow.operators.calendar import dense_table
from gateflow.operators.counts import COUNT, DIRECTION, count_hourly, keep_gates
from gateflow.sources.conform import sentinel_cut

ROWS = 60_000


@contextmanager
def settings(spark, **values):
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.fixture
def skewed(spark):
    """Every second row belongs to one file; the rest to a thousand others."""
    return spark.range(ROWS, numPartitions=8).selectExpr(
        "id AS n",
        "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('f', id % 1000) END AS file",
        "CASE WHEN id % 997 = 900 THEN 'Views' ELSE repeat('x', 200) END AS c",
    )


def expected_cut(df):
    rows = df.select("n", "file", F.expr("c = 'Views' AS m")).collect()
    first: dict = {}
    for row in rows:
        if row.m:
            first[row.file] = min(row.n, first.get(row.file, ROWS))
    return {r.n for r in rows if r.n < first.get(r.file, ROWS)}


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 0])
def test_marker_cut_is_whole_with_and_without_broadcast(spark, skewed, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    kept = sentinel_cut(skewed, "file", "n", F.col("c") == "Views")
    assert {r.n for r in kept.select("n").collect()} == expected_cut(skewed)


def test_hot_source_is_split_in_the_shuffle_join(spark, skewed, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    with settings(
        spark,
        **{
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        },
    ):
        kept = sentinel_cut(skewed, "file", "n", F.col("c") == "Views")
        found = {r.n for r in kept.collect()}
        plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
    assert found == expected_cut(skewed)


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 0])
def test_table_of_gates_keeps_every_row_of_a_hot_gate(spark, skewed, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    wanted = spark.createDataFrame([("hot",), ("f1",)], "gate string")
    kept = keep_gates(skewed, wanted, "file").groupBy("file").count().collect()
    assert dict(map(tuple, kept)) == {"hot": ROWS // 2, "f1": ROWS // 1000}


def test_hot_hour_is_counted_before_the_shuffle(spark):
    rows = spark.range(ROWS, numPartitions=8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN TIMESTAMP_NTZ '2024-01-05 08:00:00' "
        "ELSE TIMESTAMP_NTZ '2024-01-01 00:00:00' "
        "+ make_dt_interval(CAST(id % 9 AS INT), CAST(id % 24 AS INT)) END "
        "AS transaction_date",
        f"IF(id % 2 = 0, 'Entry', 'Exit') AS {DIRECTION}",
    )
    counts = count_hourly(rows)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("functions=[count(1)]") < plan.index("Exchange")
    assert plan.index("Exchange") < plan.index("functions=[partial_count(1)]")
    total = dense_table(counts).agg(F.sum(COUNT)).first()[0]
    assert total == ROWS
    by_hour = Counter()
    for row in counts.collect():
        by_hour[row.fecha.day, row.hora] += row[COUNT]
    assert by_hour[5, 8] >= ROWS // 3
