"""Wide and long forms.

The column values are known beforehand (24 hours, four bands), so a wide table
is one aggregation by its row keys, with no job to discover the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions import strict_sum_where
from gateflow.functions.fixed import BAND_LABELS, HOURS
from gateflow.functions.text import name as quoted
from gateflow.functions.text import value as literal
from gateflow.operators.counts import DIRECTION


def spread(
    df: DataFrame,
    ids: list[str],
    key: str,
    values: list,
    value: str,
    aggregate: str = "sum",
    fill=None,
) -> DataFrame:
    """One row per ``ids``, one column per listed value of ``key``.

    ``aggregate`` names a SQL aggregate; ``fill`` replaces the cells that no
    row fell into. Sums are missing where one of their values is.
    """

    def cell(wanted) -> str:
        hit = f"{quoted(key)} = {literal(wanted)}"
        filler = None if fill is None else literal(fill)
        if aggregate == "sum":
            found = strict_sum_where(quoted(value), hit, filler)
        else:
            found = f"{aggregate}({quoted(value)}) FILTER (WHERE {hit})"
            if filler is not None:
                empty = f"count(1) FILTER (WHERE {hit}) = 0"
                found = f"CASE WHEN {empty} THEN {filler} ELSE {found} END"
        return f"{found} AS {quoted(str(wanted))}"

    return df.groupBy(*ids).agg(*[F.expr(cell(v)) for v in values])


def pivot_hours(
    df: DataFrame,
    value: str,
    ids: list[str] | None = None,
    fill=None,
) -> DataFrame:
    """Hours as columns "0" to "23"."""
    return spread(df, ids or ["fecha", DIRECTION], "hora", HOURS, value, fill=fill)


def pivot_bands(
    df: DataFrame,
    ids: list[str],
    value: str,
    aggregate: str = "max",
    labels=BAND_LABELS,
) -> DataFrame:
    """Bands as columns, in the order of the day."""
    return spread(df, ids, "franja_horaria", labels, value, aggregate)


def pivot_month_day(
    df: DataFrame, value: str, direction: str = DIRECTION
) -> DataFrame:
    """Day of month and direction by hour; equal days of several months add up."""
    return (
        df.selectExpr("*", "dayofmonth(fecha) AS dia_del_mes")
        .transform(pivot_hours, value, ["dia_del_mes", direction], 0)
        .orderBy(F.col("dia_del_mes").asc_nulls_last(), direction)
    )


def unpivot_hours(wide: DataFrame, ids: list[str], name: str) -> DataFrame:
    """Hour columns back to rows, the hour as an integer."""
    long = wide.unpivot(ids, [str(h) for h in HOURS], "hora", name)
    return long.withColumn("hora", F.col("hora").cast("int"))


def as_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def by_name_pattern(df: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    """Columns whose name starts and ends as given."""
    return df.select(
        *[c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]
    )
