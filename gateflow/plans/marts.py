"""Summary tables behind profiles, heatmaps, boxplots and line charts.

Each takes the dense table, the net table or both, at most one row per calendar
day, hour and direction, and returns the data of one chart or report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions import band_rank, strict_sum, weekday_label, weekday_number
from gateflow.functions.fixed import BAND_LABELS, ENTRY, WEEKDAY_LABELS, WORKING_DAYS
from gateflow.functions.text import name as quoted
from gateflow.operators.counts import COUNT, DIRECTION
from gateflow.operators.reshape import pivot_bands
from gateflow.operators.stats import boxes_of_sets, boxplot_stats

IMPUTED = "transacciones_imputadas"
NET = "flujo_neto_ajustado"


def _with_weekday(df: DataFrame, labels=WEEKDAY_LABELS) -> DataFrame:
    return df.selectExpr(
        "*",
        f"{weekday_label('fecha', labels)} AS dia_ordenado",
        f"{weekday_number('fecha')} AS dia_orden",
    )


def _working_days(df: DataFrame) -> DataFrame:
    return df.where(F.col("tipo_dia") == WORKING_DAYS)


def _with_band_rank(df: DataFrame, labels=BAND_LABELS) -> DataFrame:
    rank = band_rank("franja_horaria", labels)
    return df.selectExpr("*", f"{rank} AS franja_orden")


def net_profile(net: DataFrame, value: str = NET) -> DataFrame:
    """Mean net level per day type and hour."""
    return net.groupBy("tipo_dia", "hora").agg(
        F.avg(value).alias("flujo_neto_promedio")
    )


def net_box_hour(net: DataFrame, value: str = NET) -> DataFrame:
    """Boxes of the net level per day type and hour."""
    return boxplot_stats(net, ["tipo_dia", "hora"], value)


def count_heatmap(
    dense: DataFrame, value: str = COUNT, direction: str = DIRECTION
) -> DataFrame:
    """Counts by day of month, direction and hour, with the row label."""
    return dense.selectExpr(
        "dayofmonth(fecha) AS dia_del_mes",
        quoted(direction),
        "hora",
        quoted(value),
        "tipo_dia",
        f"concat(dayofmonth(fecha), '.', {quoted(direction)}) AS fila",
    )


def net_heatmap(hourly_net: DataFrame) -> DataFrame:
    """Net of each hour by day of month."""
    return hourly_net.select(
        "fecha", "hora", "diferencia_neta", "tipo_dia", "franja_horaria", "dia_del_mes"
    )


def variability(
    dense: DataFrame, value: str = IMPUTED, direction: str = DIRECTION
) -> DataFrame:
    """Mean and standard deviation per day type, band and direction."""
    return dense.groupBy("tipo_dia", "franja_horaria", direction).agg(
        F.avg(value).alias("conteo_promedio"),
        F.stddev_samp(value).alias("conteo_desv_estandar"),
    )


def hourly_profile(
    dense: DataFrame, value: str = COUNT, direction: str = DIRECTION
) -> DataFrame:
    """Mean count per day type, direction and hour."""
    return dense.groupBy("tipo_dia", direction, "hora").agg(
        F.avg(value).alias("conteo_promedio_por_hora")
    )


def count_box_weekday(
    dense: DataFrame, value: str = IMPUTED, direction: str = DIRECTION
) -> DataFrame:
    """Boxes of the hourly count per weekday and direction."""
    groups = ["dia_ordenado", "dia_orden", direction]
    return dense.transform(_with_weekday).transform(boxplot_stats, groups, value)


def net_box_weekday(net: DataFrame, value: str = NET) -> DataFrame:
    """Boxes and local points of the net level per weekday."""
    groups = ["dia_ordenado", "dia_orden", "tipo_dia"]
    return net.transform(_with_weekday).transform(
        boxplot_stats, groups, value, local_points=True
    )


def band_box_working_days(
    dense: DataFrame,
    value: str = IMPUTED,
    direction: str = DIRECTION,
    labels=BAND_LABELS,
) -> DataFrame:
    """Boxes per band and direction, Monday to Friday."""
    return (
        dense.transform(_working_days)
        .transform(_with_band_rank, labels)
        .transform(boxplot_stats, ["franja_horaria", "franja_orden", direction], value)
    )


def _band_day_box(
    dense: DataFrame, value: str, extra: list[str], labels
) -> DataFrame:
    groups = ["dia_ordenado", "dia_orden", "franja_horaria", "franja_orden", *extra]
    return (
        dense.transform(_working_days)
        .transform(_with_band_rank, labels)
        .transform(_with_weekday, WEEKDAY_LABELS[:5])
        .transform(boxplot_stats, groups, value, local_points=True)
    )


def band_day_box_working_days(
    dense: DataFrame,
    value: str = COUNT,
    direction: str = DIRECTION,
    labels=BAND_LABELS,
) -> DataFrame:
    """Boxes and local points per weekday, band and direction, Monday to Friday."""
    return _band_day_box(dense, value, [direction], labels)


def pooled_band_day_working_days(
    dense: DataFrame, value: str = IMPUTED, labels=BAND_LABELS
) -> DataFrame:
    """The same with the directions pooled."""
    return _band_day_box(dense, value, [], labels)


_POINTS = ["media_local", "p10_local", "p90_local"]


def count_boxes(
    dense: DataFrame,
    value: str = IMPUTED,
    direction: str = DIRECTION,
    labels=BAND_LABELS,
) -> dict[str, DataFrame]:
    """``count_box_weekday``, ``band_box`` and ``pooled_band_day_box`` in one pass."""
    week, band = ["dia_ordenado", "dia_orden"], ["franja_horaria", "franja_orden"]
    rows = dense.transform(_with_band_rank, labels).transform(_with_weekday)
    tables = boxes_of_sets(
        rows,
        value,
        {
            "count_box_weekday": [*week, direction],
            "band_box": ["tipo_dia", *band, direction],
            "pooled_band_day_box": ["tipo_dia", *week, *band],
        },
    )
    working = {
        name: tables[name].transform(_working_days).drop("tipo_dia")
        for name in ("band_box", "pooled_band_day_box")
    }
    return {
        "count_box_weekday": tables["count_box_weekday"].drop(*_POINTS),
        "band_box": working["band_box"].drop(*_POINTS),
        "pooled_band_day_box": working["pooled_band_day_box"],
    }


def net_boxes(net: DataFrame, value: str = NET) -> dict[str, DataFrame]:
    """``net_box_hour`` and ``net_box_weekday`` in one pass."""
    tables = boxes_of_sets(
        net.transform(_with_weekday),
        value,
        {
            "net_box_hour": ["tipo_dia", "hora"],
            "net_box_weekday": ["dia_ordenado", "dia_orden", "tipo_dia"],
        },
    )
    return tables | {"net_box_hour": tables["net_box_hour"].drop(*_POINTS)}


def band_totals(
    dense: DataFrame,
    value: str = COUNT,
    name: str = "conteo_total_franja",
    direction: str = DIRECTION,
) -> DataFrame:
    """Totals per day type, direction and band."""
    return dense.groupBy("tipo_dia", direction, "franja_horaria").agg(
        F.expr(f"{strict_sum(quoted(value))} AS {quoted(name)}")
    )


def band_sums(
    dense: DataFrame,
    value: str,
    name: str,
    direction: str = DIRECTION,
    skip_missing: bool = False,
) -> DataFrame:
    """Sums per date, direction and band.

    A missing value makes its sum missing, or counts as nothing with
    ``skip_missing``, as the sums of running levels want it.
    """
    column = quoted(value)
    total = f"coalesce(sum({column}), 0)" if skip_missing else strict_sum(column)
    return dense.groupBy("fecha", direction, "franja_horaria").agg(
        F.expr(f"{total} AS {quoted(name)}")
    )


def entry_band_series(
    dense: DataFrame,
    value: str,
    direction: str = DIRECTION,
    labels=BAND_LABELS,
    skip_missing: bool = False,
) -> DataFrame:
    """Entries per date with the bands as columns."""
    entries = dense.where(F.col(direction) == ENTRY)
    sums = band_sums(entries, value, "total", direction, skip_missing)
    return pivot_bands(sums, ["fecha", direction], "total", labels=labels)


def by_band(
    df: DataFrame,
    ids: list[str],
    value: str,
    aggregate: str,
    labels=BAND_LABELS,
) -> DataFrame:
    """A statistic per ``ids`` and band, bands as columns, known day types only."""
    known = df.dropna(subset=["tipo_dia"])
    return pivot_bands(known, ids, value, aggregate, labels)


def net_mean_band(net: DataFrame, value: str, labels=BAND_LABELS) -> DataFrame:
    return by_band(net, ["tipo_dia"], value, "avg", labels)


def net_sd_band(net: DataFrame, value: str, labels=BAND_LABELS) -> DataFrame:
    return by_band(net, ["tipo_dia"], value, "stddev_samp", labels)


def count_mean_band(
    dense: DataFrame,
    value: str = COUNT,
    direction: str = DIRECTION,
    labels=BAND_LABELS,
) -> DataFrame:
    return by_band(dense, ["tipo_dia", direction], value, "avg", labels)


def count_sd_band(
    dense: DataFrame,
    value: str = COUNT,
    direction: str = DIRECTION,
    labels=BAND_LABELS,
) -> DataFrame:
    return by_band(dense, ["tipo_dia", direction], value, "stddev_samp", labels)
