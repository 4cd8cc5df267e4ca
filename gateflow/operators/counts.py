"""From transactions to hourly counts: the only step that meets raw rows.

Every aggregate here is combined on the map side, so a gate, day or hour that
holds a third of all rows still sends one row per task to the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions.fixed import DEFAULT_GATES
from gateflow.functions.text import name as quoted
from gateflow.operators.joins import broadcast_if_small

DIRECTION = "transit_direction_description"
TIMESTAMP = "transaction_date"
COUNT = "transacciones_por_hora"


def keep_gates(
    df: DataFrame,
    gates: Iterable[str] | DataFrame = DEFAULT_GATES,
    key: str = "tema_key",
) -> DataFrame:
    """Rows of the listed gates.

    A list becomes an ``In`` filter that reaches the scan; a table of gates
    (first column) becomes a semi join.
    """
    if isinstance(gates, DataFrame):
        wanted = gates.select(F.col(gates.columns[0]).alias(key)).distinct()
        return df.join(broadcast_if_small(wanted), key, "left_semi")
    return df.where(F.col(key).isin(list(gates)))


def with_date_hour(df: DataFrame, timestamp: str = TIMESTAMP) -> DataFrame:
    moment = quoted(timestamp)
    return df.selectExpr(
        "*", f"to_date({moment}) AS fecha", f"hour({moment}) AS hora"
    )


def count_hourly(
    df: DataFrame,
    direction: str = DIRECTION,
    timestamp: str = TIMESTAMP,
    name: str = COUNT,
) -> DataFrame:
    """Transactions per date, direction and hour."""
    return (
        df.transform(with_date_hour, timestamp)
        .groupBy("fecha", direction, "hora")
        .agg(F.count(F.lit(1)).alias(name))
    )


def sum_in_out(
    df: DataFrame,
    timestamp: str = "ts",
    entries: str = "entradas",
    exits: str = "salidas",
) -> DataFrame:
    """Entries, exits and net people per date and hour of a pre-counted export."""
    sides = [quoted(entries), quoted(exits)]
    return (
        df.transform(with_date_hour, timestamp)
        .groupBy("fecha", "hora")
        .agg(*[F.expr(f"coalesce(sum({c}), 0) AS {c}") for c in sides])
        .selectExpr("*", f"{' - '.join(sides)} AS personas_por_hora")
    )


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("fecha").alias("primera_fecha"), F.max("fecha").alias("ultima_fecha")
    )


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Stop with ``message`` if the frame is empty; reads at most one row."""
    if df.isEmpty():
        raise ValueError(message)
    return df
