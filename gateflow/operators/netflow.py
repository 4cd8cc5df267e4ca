"""Net flow: entries minus exits.

Days are matched by key, not by row position, in a single aggregation by the
day and hour; no pivot has to be joined with another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions import label_time, running_sum, strict_sum_where
from gateflow.functions.fixed import (
    BAND_LABELS,
    ENTRY,
    EXIT,
    HOURS,
    SEED_HOUR,
    TIME_BANDS,
)
from gateflow.functions.text import name as quoted
from gateflow.functions.text import value as literal
from gateflow.operators.counts import DIRECTION
from gateflow.operators.reshape import pivot_hours, spread


def _side(value: str, direction: str, side: str, fill) -> str:
    hit = f"{quoted(direction)} = {literal(side)}"
    return strict_sum_where(
        quoted(value), hit, None if fill is None else literal(fill)
    )


def _two_sides(direction: str) -> str:
    return f"{quoted(direction)} IN ({literal(ENTRY)}, {literal(EXIT)})"


def net_by_hour(
    df: DataFrame,
    value: str,
    name: str,
    direction: str = DIRECTION,
    fill=0,
    keep_missing_dates: bool = False,
) -> DataFrame:
    """Entries minus exits of ``value`` per date and hour.

    A side without a row counts as ``fill``; with ``fill=None`` the difference is
    then missing. A side with a missing value makes the difference missing. Other
    directions take no part.
    """
    rows = df.where(_two_sides(direction))
    if not keep_missing_dates:
        rows = rows.where("fecha IS NOT NULL")
    sides = [_side(value, direction, side, fill) for side in (ENTRY, EXIT)]
    return rows.groupBy("fecha", "hora").agg(
        F.expr(f"{' - '.join(sides)} AS {quoted(name)}")
    )


def net_hourly(
    df: DataFrame,
    value: str,
    name: str = "diferencia_neta",
    direction: str = DIRECTION,
    bands=TIME_BANDS,
) -> DataFrame:
    """Net of each single hour with its day of month and time labels."""
    return (
        df.transform(net_by_hour, value, name, direction, 0, True)
        .transform(label_time, bands=bands)
        .selectExpr("*", "dayofmonth(fecha) AS dia_del_mes")
    )


def net_cumulative(
    df: DataFrame,
    value: str,
    name: str,
    direction: str = DIRECTION,
    bands=TIME_BANDS,
) -> DataFrame:
    """Occupancy curve: net of the running counts, with time labels.

    The labels come from the date and hour themselves, so no row is doubled by
    attaching them.
    """
    net = df.transform(net_by_hour, value, name, direction)
    return label_time(net, bands=bands)


def net_wide(
    df: DataFrame,
    value: str = "conteo_acumulado",
    direction: str = DIRECTION,
    fill=0,
) -> DataFrame:
    """Net per date with the hours as columns."""
    return df.transform(net_by_hour, value, "neto", direction, fill).transform(
        pivot_hours, "neto", ["fecha"]
    )


def full_outer_sides(
    df: DataFrame, value: str, direction: str = DIRECTION
) -> DataFrame:
    """Both directions side by side per date: "0_Entry" to "23_Exit".

    Cells that are absent or missing are 0. A day seen in one direction only keeps
    its row.
    """
    sided = df.where(f"fecha IS NOT NULL AND {_two_sides(direction)}").selectExpr(
        "fecha", f"concat_ws('_', hora, {quoted(direction)}) AS celda", quoted(value)
    )
    cells = [f"{hour}_{side}" for side in (ENTRY, EXIT) for hour in HOURS]
    return spread(sided, ["fecha"], "celda", cells, value).fillna(0, subset=cells)


def net_of_sides(sides: DataFrame) -> DataFrame:
    """Difference of the two halves of ``full_outer_sides``, hour by hour."""
    return sides.selectExpr(
        "fecha", *[f"`{hour}_{ENTRY}` - `{hour}_{EXIT}` AS `{hour}`" for hour in HOURS]
    )


def closing_level(
    df: DataFrame, keys: list[str], value: str = "conteo_acumulado"
) -> DataFrame:
    """Level of the running count at the end of each band."""
    return df.groupBy(*keys, "franja_horaria").agg(
        F.max(value).alias("conteo_final_franja")
    )


def net_by_band(
    df: DataFrame,
    value: str = "conteo_acumulado",
    direction: str = DIRECTION,
    labels=BAND_LABELS,
) -> DataFrame:
    """Closing level of entries minus that of exits, bands as columns."""

    def level(side: str, band: str) -> str:
        hit = f"{quoted(direction)} = {literal(side)}"
        hit += f" AND franja_horaria = {literal(band)}"
        return f"max({quoted(value)}) FILTER (WHERE {hit})"

    def net(band: str) -> str:
        return f"{level(ENTRY, band)} - {level(EXIT, band)} AS {quoted(band)}"

    return (
        df.where(_two_sides(direction))
        .groupBy("fecha")
        .agg(*[F.expr(net(band)) for band in labels])
    )


def day_carry_over(
    net: DataFrame, value: str, name: str = "neto_arrastrado", seed_hour: int = SEED_HOUR
) -> DataFrame:
    """Per hour, net summed over the days after the first one.

    The sum starts from the level of the first day at ``seed_hour``. A window
    holds one row per calendar day.
    """
    first_day = net.agg(F.min("fecha")).scalar()
    seed = (
        net.where(F.col("hora") == seed_hour)
        .agg(F.min_by(F.col(value), F.col("fecha")))
        .scalar()
    )
    over_days = F.expr(running_sum(quoted(value), ["hora"], "fecha"))
    return net.where(F.col("fecha") > first_day).select(
        "fecha", "hora", (seed + over_days).alias(name)
    )
