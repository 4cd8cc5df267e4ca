"""Group statistics, two-sigma limits and the replacements built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions import floor_at_zero, if_else
from gateflow.functions.fixed import SIGMAS
from gateflow.functions.text import name as quoted
from gateflow.functions.text import value as literal
from gateflow.operators.counts import COUNT, DIRECTION
from gateflow.operators.joins import left_join_null_safe

# A value that lies on a limit is inside; differences below this many decimals
# come from the order of summation and are not differences.
DECIMALS = 9


def stats_groups(direction: str = DIRECTION) -> list[str]:
    return ["tipo_dia", "franja_horaria", direction]


def group_mean_sd(
    df: DataFrame,
    groups: list[str],
    value: str = COUNT,
    mean: str = "mu",
    sd: str = "sigma",
) -> DataFrame:
    """Mean and sample standard deviation per group."""
    return df.groupBy(*groups).agg(
        F.avg(value).alias(mean), F.stddev_samp(value).alias(sd)
    )


def two_sigma_limits(stats: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    return stats.selectExpr(
        "*",
        f"mu - {literal(float(sigmas))} * sigma AS limite_inferior",
        f"mu + {literal(float(sigmas))} * sigma AS limite_superior",
    )


def attach_group_stats(
    df: DataFrame,
    groups: list[str],
    value: str = COUNT,
    sigmas: float = SIGMAS,
) -> DataFrame:
    """Each row with the statistics and limits of its group."""
    stats = df.transform(group_mean_sd, groups, value).transform(
        two_sigma_limits, sigmas
    )
    return left_join_null_safe(df, stats, groups)


def outside(value: str, lower: str, upper: str) -> str:
    """Strictly below the lower or above the upper limit, NULL if unknown."""
    below = f"round({value} - ({lower}), {DECIMALS}) < 0"
    above = f"round({value} - ({upper}), {DECIMALS}) > 0"
    return f"({below} OR {above})"


def _replaced(value: str) -> str:
    is_outlier = outside(quoted(value), "limite_inferior", "limite_superior")
    return if_else(is_outlier, "mu", f"CAST({quoted(value)} AS DOUBLE)")


def impute_two_sigma(
    df: DataFrame,
    value: str = COUNT,
    name: str = "transacciones_imputadas",
    direction: str = DIRECTION,
    sigmas: float = SIGMAS,
) -> DataFrame:
    """Outliers of each day type, band and direction become the group mean.

    The raw value is kept; the imputed one is never negative.
    """
    attached = attach_group_stats(df, stats_groups(direction), value, sigmas)
    floored = floor_at_zero(f"({_replaced(value)})")
    return attached.selectExpr("*", f"{floored} AS {quoted(name)}")


def correct_two_sigma(
    df: DataFrame,
    value: str = COUNT,
    name: str = "conteo_corregido",
    direction: str = DIRECTION,
    sigmas: float = SIGMAS,
) -> DataFrame:
    """Like ``impute_two_sigma``, without the floor at zero."""
    attached = attach_group_stats(df, stats_groups(direction), value, sigmas)
    return attached.selectExpr("*", f"{_replaced(value)} AS {quoted(name)}")


def adjust_net_people(
    df: DataFrame, value: str = "personas_por_hora", sigmas: float = SIGMAS
) -> DataFrame:
    """Net people far from the mean of their hour become that mean, with a flag."""
    stats = group_mean_sd(df, ["hora"], value, "media", "desviacion")
    away = f"abs({quoted(value)} - media) - {literal(float(sigmas))} * desviacion"
    flag = "se_sale_de_media"
    adjusted = if_else(flag, "media", f"CAST({quoted(value)} AS DOUBLE)")
    return (
        left_join_null_safe(df, stats, ["hora"])
        .selectExpr("*", f"round({away}, {DECIMALS}) > 0 AS {flag}")
        .selectExpr("*", f"{adjusted} AS {quoted(value + '_ajustado')}")
    )


def imputation_audit(
    imputed: DataFrame,
    value: str = COUNT,
    name: str = "transacciones_imputadas",
    direction: str = DIRECTION,
) -> DataFrame:
    """Original value, limits and imputed value side by side."""
    return imputed.select(
        "fecha",
        "hora",
        "tipo_dia",
        "franja_horaria",
        direction,
        value,
        "limite_inferior",
        "limite_superior",
        name,
    )
