"""Full hourly calendar and running counts within the day.

These work on hourly counts, never on raw rows: a group (date, direction) has
24 rows at most, whatever the size of the source.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions import label_time, running_sum
from gateflow.functions.fixed import HOURS, TIME_BANDS
from gateflow.functions.text import name as quoted
from gateflow.functions.text import value as literal
from gateflow.operators.counts import COUNT, DIRECTION
from gateflow.session import store_placed

# Dates are spread over this many join keys when paired with the directions.
SLOTS = 32


def calendar_pairs(
    counts: DataFrame,
    direction: str = DIRECTION,
    directions: Iterable[str] | None = None,
) -> DataFrame:
    """Every date with every direction.

    Directions given by the caller are unrolled in place. Directions found in
    the data are copied once per slot and meet the dates of that slot in an
    equi-join, so neither side has to fit into one task.
    """
    dates = counts.select("fecha").distinct()
    if directions is not None:
        listed = ", ".join(map(literal, directions))
        return dates.selectExpr(
            "fecha", f"explode(array({listed})) AS {quoted(direction)}"
        )
    copies = (
        counts.select(direction)
        .distinct()
        .selectExpr("*", f"explode(sequence(0, {SLOTS - 1})) AS slot")
    )
    slot = f"pmod(hash(fecha), {SLOTS}) AS slot"
    return dates.selectExpr("fecha", slot).join(copies, "slot").select("fecha", direction)


_EACH_HOUR = f"explode(sequence({HOURS[0]}, {HOURS[-1]})) AS hora"


def calendar_grid(
    counts: DataFrame,
    direction: str = DIRECTION,
    directions: Iterable[str] | None = None,
) -> DataFrame:
    """Every date with every direction and every hour."""
    pairs = calendar_pairs(counts, direction, directions)
    return pairs.selectExpr("fecha", quoted(direction), _EACH_HOUR)


def densify_hours(
    counts: DataFrame,
    value: str = COUNT,
    direction: str = DIRECTION,
    directions: Iterable[str] | None = None,
) -> DataFrame:
    """Hourly counts on the full calendar, 0 where nothing was counted.

    The calendar is added as zero rows and summed with the counts, which needs
    no join and treats a missing date or direction as a value of its own. Rows
    are placed by (date, direction) once; sum, running count and hour pivot
    all use that placement.
    """
    keys = ["fecha", direction, "hora"]
    seen = counts.where(f"hora BETWEEN {HOURS[0]} AND {HOURS[-1]}")
    if directions is not None:
        directions = list(directions)
        seen = seen.where(F.col(direction).isin(directions))
    zero = f"CAST(0 AS {counts.schema[value].dataType.simpleString()})"
    zeros = calendar_grid(counts, direction, directions).selectExpr(
        "*", f"{zero} AS {quoted(value)}"
    )
    return (
        seen.select(*keys, value)
        .unionByName(zeros)
        .repartition("fecha", direction)
        .groupBy(*keys)
        .agg(F.sum(value).alias(value))
    )


def accumulate(
    df: DataFrame,
    value: str = COUNT,
    name: str = "conteo_acumulado",
    direction: str = DIRECTION,
) -> DataFrame:
    """Running sum of ``value`` over the hours of each date and direction."""
    days = ["fecha", direction]
    level = running_sum(quoted(value), days, "hora NULLS LAST")
    return df.selectExpr("*", f"{level} AS {quoted(name)}")


def place_counts(
    counts: DataFrame,
    direction: str = DIRECTION,
    value: str = COUNT,
    buckets: int | None = None,
) -> DataFrame:
    """Hourly counts stored by (date, direction), for ``densify_placed``.

    A date and direction of the calendar that has no count gets a row without an hour,
    so that every day of the calendar is found where its counts would be.
    """
    keys = ["fecha", direction]
    seen = counts.where(f"hora BETWEEN {HOURS[0]} AND {HOURS[-1]}").select(
        *keys, "hora", value
    )
    zero = f"CAST(0 AS {counts.schema[value].dataType.simpleString()})"
    pairs = calendar_pairs(counts, direction).selectExpr(
        *map(quoted, keys), "CAST(NULL AS INT) AS hora", f"{zero} AS {quoted(value)}"
    )
    return store_placed(seen.unionByName(pairs), keys, ["hora"], buckets)


def densify_placed(
    placed: DataFrame, direction: str = DIRECTION, value: str = COUNT
) -> DataFrame:
    """``densify_hours`` of counts stored by ``place_counts``, without a shuffle.

    The 24 hours of a day are unrolled from a map of its counts, which are at hand.
    """
    day = f"collect_list(struct(hora, {quoted(value)})) FILTER (WHERE hora IS NOT NULL)"
    return (
        placed.groupBy("fecha", direction)
        .agg(F.expr(f"map_from_entries({day})").alias("__horas"))
        .selectExpr("fecha", quoted(direction), _EACH_HOUR, "__horas")
        .selectExpr(
            "fecha", quoted(direction), "hora", f"coalesce(__horas[hora], 0) AS {quoted(value)}"
        )
    )


def dense_table_of_placed(
    placed: DataFrame, direction: str = DIRECTION, value: str = COUNT, bands=TIME_BANDS
) -> DataFrame:
    """``dense_table`` of placed counts; pivots by day need no shuffle either."""
    return (
        placed.transform(densify_placed, direction, value)
        .transform(accumulate, value, "conteo_acumulado", direction)
        .transform(label_time, bands=bands)
    )


def dense_table(
    counts: DataFrame,
    direction: str = DIRECTION,
    directions: Iterable[str] | None = None,
    value: str = COUNT,
    bands=TIME_BANDS,
) -> DataFrame:
    """Dense hourly counts with running count and time labels."""
    return (
        counts.transform(densify_hours, value, direction, directions)
        .transform(accumulate, value, "conteo_acumulado", direction)
        .transform(label_time, bands=bands)
    )
