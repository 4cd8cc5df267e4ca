"""The flow over a folder that grows, from counts that are kept up to date.

Beside the rows of the ledger's batches stand the counts of their files (``parts``) and
the hourly totals of all files (``totals``), by gate, so that any list of gates can be
asked for later. A refresh counts the rows of its own batch, takes back the parts of
files that changed or went, and adds those of files that came or changed; no other row
is read. Totals belong to a version of the ledger: if a run ends between the two, the
next one starts from the last complete totals and the ledger they belong to.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.functions.fixed import DEFAULT_GATES, SIGMAS, TIME_BANDS
from gateflow.operators.counts import COUNT, keep_gates, require_rows
from gateflow.operators.increments import (
    count_by_source,
    merge_counts,
    refreshed_totals,
)
from gateflow.plans.flow import precounted_flow, tables_of_counts
from gateflow.session import materialise
from gateflow.sources.conform import split_quarantine
from gateflow.sources.ledger import (
    Refreshed,
    complete_versions,
    loaded_schema,
    read_batches,
    read_ledger,
    refresh_workbooks,
    refreshed_rows,
)
from gateflow.sources.workbooks import OLD_EXPORT, Layout, whole_files


def _parts_schema(layout: Layout) -> str:
    keys = f"source_path string, `{layout.gate}` string"
    return f"{keys}, fecha date, `{layout.direction}` string, hora int, {COUNT} bigint"


def _only(entries: DataFrame, others: DataFrame) -> DataFrame:
    return entries.join(others, ["path", "batch"], "left_anti")


def refreshed_counts(
    spark: SparkSession, refreshed: Refreshed, layout: Layout = OLD_EXPORT
) -> tuple[DataFrame, DataFrame]:
    """Hourly totals by gate, and the parts of all files, as of the refresh."""
    table, schema = refreshed.table, _parts_schema(layout)
    done = complete_versions(spark, f"{table}/totals")
    base = max((v for v in done if v <= refreshed.version), default=0)
    # A reader's schema, so that tables without a row have their columns too.
    totals_schema = schema.partition(", ")[2]
    before = read_ledger(spark, table, base)
    came, went = _only(refreshed.ledger, before), _only(before, refreshed.ledger)
    for row in came.select("batch").distinct().collect():  # one a refresh
        path = f"{table}/parts/batch={row['batch']}"
        own = refreshed.ledger.where(F.col("batch") == row["batch"])
        rows = read_batches(spark, table, "rows", loaded_schema(layout), own).drop("batch")
        good, _ = split_quarantine(whole_files(rows))
        parts = count_by_source(
            good, ["source_path", layout.gate], layout.direction, layout.timestamp
        )
        parts.write.mode("overwrite").parquet(path)
    parts = read_batches(spark, table, "parts", schema, refreshed.ledger).drop("batch")
    if base == refreshed.version:
        return spark.read.schema(totals_schema).parquet(f"{table}/totals/version={base}"), parts
    totals = spark.createDataFrame([], totals_schema)
    if base:
        totals = spark.read.schema(totals_schema).parquet(f"{table}/totals/version={base}")
    renewed = refreshed_totals(
        totals,
        read_batches(spark, table, "parts", schema, went).drop("batch"),
        read_batches(spark, table, "parts", schema, came).drop("batch"),
    )
    path = f"{table}/totals/version={refreshed.version}"
    renewed.write.mode("overwrite").parquet(path)
    return spark.read.schema(totals_schema).parquet(path), parts


def flow_from_refreshed_folder(
    spark: SparkSession,
    folder: str,
    table: str,
    gates: Iterable[str] | DataFrame = DEFAULT_GATES,
    layout: Layout = OLD_EXPORT,
    sigmas: float = SIGMAS,
    bands=TIME_BANDS,
) -> dict[str, DataFrame]:
    """The results of ``flow_from_folder``, decoding and counting changed files only.

    ``table`` keeps what was loaded between the runs. ``files`` has the status of every
    file: new, changed, touched, same or removed. Exports that are counted already are
    summed from all stored rows, as they have no gate to keep counts by.
    """
    listed = None if isinstance(gates, DataFrame) else list(gates)
    refreshed = refresh_workbooks(spark, folder, table, layout, listed)
    rows = refreshed_rows(spark, refreshed, folder, layout)
    good, quarantine = split_quarantine(rows)
    if layout.gate is None:
        untimed = good.where(F.col(layout.timestamp).isNull()).groupBy("source_path")
        untimed = untimed.agg(F.count(F.lit(1)).alias("n"))
        tables = {"people": precounted_flow(good, layout.timestamp, sigmas=sigmas)}
    else:
        totals, parts = refreshed_counts(spark, refreshed, layout)
        untimed = parts.where("fecha IS NULL").groupBy("source_path")
        untimed = untimed.agg(F.sum(COUNT).alias("n"))
        wanted = totals.transform(keep_gates, gates if listed is None else listed, layout.gate)
        counts = materialise(merge_counts(wanted.drop(layout.gate)))
        require_rows(counts, "no transactions of the wanted gates")
        tables = tables_of_counts(counts, layout.direction, sigmas, bands)
    return {**tables, "quarantine": quarantine, "untimed": untimed, "files": refreshed.changes()}
