"""Group statistics as states that merge.

A state is the number of known values of a group, their mean, and the sum of squared
distances from it. States of disjoint rows, such as the days of a calendar, merge into
the state of all of them, so a new day needs no old row, and a renewed day replaces its
own states. The squares are taken from the common mean, never as a difference of large
sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions.text import name as quoted
from gateflow.functions.text import names
from gateflow.operators.counts import COUNT

N, MEAN, SQUARES = "n", "media", "cuadrados"


def moment_states(df: DataFrame, keys: list[str], value: str = COUNT) -> DataFrame:
    """State of each group, such as each day and direction. Missing values do not count.

    A group without a known value has n = 0 and no mean; a missing key is a group.
    """
    x = f"CAST({quoted(value)} AS DOUBLE)"
    return df.groupBy(*keys).agg(
        F.expr(f"count({quoted(value)})").alias(N),
        F.expr(f"avg({x})").alias(MEAN),
        F.expr(f"CASE WHEN count({x}) > 0 THEN var_pop({x}) * count({x}) ELSE 0D END").alias(
            SQUARES
        ),
    )


def merge_moments(keys: list[str], *states: DataFrame) -> DataFrame:
    """States of the groups ``keys`` from states of disjoint parts of their rows.

    The parts are rows of one or more tables, at most one a day and table, not raw rows.
    """
    rows = states[0].select(*keys, N, MEAN, SQUARES)
    for state in states[1:]:
        rows = rows.unionByName(state.select(*keys, N, MEAN, SQUARES))
    group = f"OVER (PARTITION BY {names(keys)})"
    common = f"sum({MEAN} * {N}) {group} / sum(IF({N} > 0, {N}, NULL)) {group}"
    return (
        rows.selectExpr("*", f"{common} AS __comun")
        .groupBy(*keys)
        .agg(
            F.expr(f"sum({N}) AS {N}"),
            F.expr(f"first(__comun) AS {MEAN}"),
            F.expr(
                f"sum({SQUARES} + IF({N} > 0, {N} * pow({MEAN} - __comun, 2), 0D)) AS {SQUARES}"
            ),
        )
    )


def replace_states(states: DataFrame, renewed: DataFrame, part: str = "fecha") -> DataFrame:
    """Stored states with those of renewed days in place of the old ones."""
    days = renewed.select(F.col(part).alias("__renewed")).distinct()
    same = F.col(part).eqNullSafe(F.col("__renewed"))
    return states.join(days, same, "left_anti").unionByName(renewed)


def mean_sd_of_states(states: DataFrame, mean: str = "mu", sd: str = "sigma") -> DataFrame:
    """Mean and sample standard deviation, which one value alone does not have."""
    keys = [column for column in states.columns if column not in (N, MEAN, SQUARES)]
    return states.selectExpr(
        *map(quoted, keys),
        f"{MEAN} AS {quoted(mean)}",
        f"CASE WHEN {N} > 1 THEN sqrt({SQUARES} / ({N} - 1)) END AS {quoted(sd)}",
    )
