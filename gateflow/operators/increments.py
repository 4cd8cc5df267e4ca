"""Hourly counts that can be taken back.

Counts are kept by source as well: the part of a source is what its rows add to the
totals. When a source changes or goes, its old part is subtracted and its new one added,
so totals follow without reading the rows of any other source. A part has at most one
row per gate, date, direction and hour, however many transactions the source has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.operators.counts import COUNT, DIRECTION, TIMESTAMP, with_date_hour


def count_by_source(
    df: DataFrame,
    keys: list[str],
    direction: str = DIRECTION,
    timestamp: str = TIMESTAMP,
    name: str = COUNT,
) -> DataFrame:
    """Transactions per ``keys`` (the source, perhaps the gate), date, direction, hour."""
    return (
        df.transform(with_date_hour, timestamp)
        .groupBy(*keys, "fecha", direction, "hora")
        .agg(F.count(F.lit(1)).alias(name))
    )


def merge_counts(*tables: DataFrame, value: str = COUNT) -> DataFrame:
    """Sum of counts by all their other columns; cells that come to 0 are gone.

    A missing date, direction or hour is a value of its own. A negative sum says that
    more was taken back than was there, and stops the job.
    """
    keys = [column for column in tables[0].columns if column != value]
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    total = F.sum(value)
    checked = F.when(total >= 0, total).otherwise(
        F.raise_error(F.lit("more was taken back than was counted"))
    )
    return rows.groupBy(*keys).agg(checked.alias(value)).where(F.col(value) != 0)


def taken_back(parts: DataFrame, value: str = COUNT) -> DataFrame:
    """Parts with the opposite sign."""
    return parts.withColumn(value, -F.col(value))


def refreshed_totals(
    totals: DataFrame,
    old_parts: DataFrame,
    new_parts: DataFrame,
    source: str = "source_path",
    value: str = COUNT,
) -> DataFrame:
    """Totals after sources changed.

    ``old_parts`` are the stored parts of the sources that changed or went, ``new_parts``
    those of the sources that came or changed.
    """
    return merge_counts(
        totals,
        taken_back(old_parts, value).drop(source),
        new_parts.drop(source),
        value=value,
    )
