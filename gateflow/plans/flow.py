"""The flow from transactions to net flow.

Raw transactions are read once, for the hourly counts. These have one row per
date, direction and hour, and every later step starts from their stored copy.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gateflow.functions.fixed import DEFAULT_GATES, SIGMAS, TIME_BANDS
from gateflow.operators.calendar import accumulate, dense_table
from gateflow.operators.counts import (
    COUNT,
    DIRECTION,
    TIMESTAMP,
    count_hourly,
    keep_gates,
    require_rows,
    sum_in_out,
)
from gateflow.operators.impute import adjust_net_people, impute_two_sigma
from gateflow.operators.netflow import net_by_hour, net_cumulative, net_hourly
from gateflow.operators.reshape import pivot_hours
from gateflow.session import materialise
from gateflow.sources.conform import split_quarantine
from gateflow.sources.tallies import tallied
from gateflow.sources.workbooks import OLD_EXPORT, Layout, ingest_workbooks

IMPUTED = "transacciones_imputadas"
IMPUTED_LEVEL = "conteo_acumulado_imputado"
NET = "flujo_neto_ajustado"


def hourly_counts(
    transactions: DataFrame,
    gates: Iterable[str] | DataFrame = DEFAULT_GATES,
    gate: str = "tema_key",
    direction: str = DIRECTION,
    timestamp: str = TIMESTAMP,
) -> DataFrame:
    """Stored hourly counts of the wanted gates."""
    return materialise(
        transactions.transform(keep_gates, gates, gate).transform(
            count_hourly, direction, timestamp
        )
    )


def imputed_table(
    counts: DataFrame,
    direction: str = DIRECTION,
    sigmas: float = SIGMAS,
    bands=TIME_BANDS,
) -> DataFrame:
    """Dense table with raw and imputed counts and their running sums."""
    return (
        dense_table(counts, direction, bands=bands)
        .transform(impute_two_sigma, COUNT, IMPUTED, direction, sigmas)
        .transform(accumulate, IMPUTED, IMPUTED_LEVEL, direction)
    )


def flow_tables(
    transactions: DataFrame,
    gates: Iterable[str] | DataFrame = DEFAULT_GATES,
    gate: str = "tema_key",
    direction: str = DIRECTION,
    timestamp: str = TIMESTAMP,
    sigmas: float = SIGMAS,
    bands=TIME_BANDS,
    check: bool = False,
) -> dict[str, DataFrame]:
    """All results of the flow by name.

    ``counts`` as counted, ``imputed`` on the full calendar, ``net`` as the
    occupancy curve of the imputed counts and ``hourly_net`` as the difference
    within each hour. ``check`` stops when no row passes the gate filter. The
    imputed table is stored too, because the net tables and the summary tables
    all start from it.
    """
    counts = hourly_counts(transactions, gates, gate, direction, timestamp)
    if check:
        require_rows(counts, "no transactions of the wanted gates")
    return tables_of_counts(counts, direction, sigmas, bands)


def tables_of_counts(
    counts: DataFrame,
    direction: str = DIRECTION,
    sigmas: float = SIGMAS,
    bands=TIME_BANDS,
) -> dict[str, DataFrame]:
    """The results of ``flow_tables`` from stored hourly counts."""
    imputed = materialise(imputed_table(counts, direction, sigmas, bands))
    return {
        "counts": counts,
        "imputed": imputed,
        "net": net_cumulative(imputed, IMPUTED_LEVEL, NET, direction, bands),
        "hourly_net": net_hourly(imputed, IMPUTED, "diferencia_neta", direction, bands),
    }


def flow_from_folder(
    spark: SparkSession,
    folder: str,
    gates: Iterable[str] | DataFrame = DEFAULT_GATES,
    layout: Layout = OLD_EXPORT,
    table: str | None = None,
    sigmas: float = SIGMAS,
    bands=TIME_BANDS,
    tally: Observation | None = None,
) -> dict[str, DataFrame]:
    """Exports of a folder through the whole flow; unread files in ``quarantine``.

    The loaded rows go to ``table``, or to the session's shared folder, so that
    each workbook is decoded once. ``untimed`` counts the rows per file whose time
    cannot be read; the calendar has no place for them. Exports that are counted
    already (a layout without a gate) give their net ``people`` by hour. ``tally`` gets
    the counters of the load (see ``tallied``) from the job that writes ``table``.
    """
    watch = None
    if tally is not None:
        listed = None if isinstance(gates, DataFrame) else list(gates)
        watch = partial(tallied, layout=layout, gates=listed, tally=tally)
    loaded = ingest_workbooks(spark, folder, layout, table, watch)
    rows, quarantine = split_quarantine(loaded)
    untimed = (
        rows.where(F.col(layout.timestamp).isNull())
        .groupBy("source_path")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if layout.gate is None:
        tables = {"people": precounted_flow(rows, layout.timestamp, sigmas=sigmas)}
    else:
        tables = flow_tables(
            rows,
            gates,
            layout.gate,
            layout.direction,
            layout.timestamp,
            sigmas,
            bands,
            check=True,
        )
    return {**tables, "quarantine": quarantine, "untimed": untimed}


def sparse_flow(
    transactions: DataFrame,
    gates: Iterable[str] | DataFrame = DEFAULT_GATES,
    gate: str = "tema_key",
    direction: str = DIRECTION,
    timestamp: str = TIMESTAMP,
) -> dict[str, DataFrame]:
    """The flow without a calendar: hours nobody passed stay absent.

    ``counts`` with their running sums, both with the hours as columns, and ``net``
    by hour, which is missing where one side is.
    """
    counts = hourly_counts(transactions, gates, gate, direction, timestamp)
    running = accumulate(counts, COUNT, "conteo_acumulado", direction)
    return {
        "counts": running,
        "counts_by_hour": pivot_hours(counts, COUNT, ["fecha", direction]),
        "levels_by_hour": pivot_hours(running, "conteo_acumulado", ["fecha", direction]),
        "net": net_by_hour(counts, COUNT, "diferencia", direction, fill=None),
    }


def precounted_flow(
    df: DataFrame,
    timestamp: str = "ts",
    entries: str = "entradas",
    exits: str = "salidas",
    sigmas: float = SIGMAS,
) -> DataFrame:
    """Net people per date and hour of a pre-counted export, raw and adjusted."""
    net = "personas_por_hora"
    summed = materialise(sum_in_out(df, timestamp, entries, exits))
    return summed.transform(adjust_net_people, net, sigmas).select(
        "fecha", "hora", entries, exits, net, f"{net}_ajustado"
    )


def occupancy(transactions: DataFrame, **columns) -> DataFrame:
    """Imputed occupancy curve of raw transactions.

    The hourly counts are computed and stored when this is called; the rest is lazy.
    """
    counts = hourly_counts(transactions, **columns)
    direction = columns.get("direction", DIRECTION)
    imputed = imputed_table(counts, direction)
    return net_cumulative(imputed, IMPUTED_LEVEL, NET, direction)
