"""Running sums in two levels, so that a key over a long range is many tasks.

A window over all rows of a key is one task a key. Here the order of a key is cut into
blocks: rows are added up within their block, the totals of the blocks, one row each, are
added up over the key, and each row takes the sum of the blocks before its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions import running_sum, strict_sum
from gateflow.functions.fixed import SEED_HOUR
from gateflow.functions.text import name as quoted
from gateflow.functions.text import names
from gateflow.operators.joins import left_join_null_safe

#: Days of a block of the carry-over.
BLOCK_DAYS = 64


def running_sum_in_blocks(
    df: DataFrame, value: str, name: str, keys: list[str], order: str, block: str
) -> DataFrame:
    """Running sum of ``value`` over each key, NULL from the first NULL value on.

    ``order`` is the column the rows of a key stand in, and ``block`` an expression that
    does not fall while ``order`` rises, such as a number of days divided by 64. A task
    holds a block's rows, and the totals of all blocks of a key.
    """
    rows = df.selectExpr("*", f"{block} AS __bloque")
    blocked = [*keys, "__bloque"]
    totals = rows.groupBy(*blocked).agg(F.expr(f"{strict_sum(quoted(value))} AS __total"))
    earlier = (
        f"OVER (PARTITION BY {names(keys)} ORDER BY __bloque "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    before = (
        f"CASE WHEN count(__total) {earlier} = count(1) {earlier} "
        f"THEN coalesce(sum(__total) {earlier}, 0) END"
    )
    prefix = totals.selectExpr(*map(quoted, blocked), f"{before} AS __antes")
    inside = running_sum(quoted(value), blocked, f"{quoted(order)} NULLS LAST")
    return (
        left_join_null_safe(rows, prefix, blocked)
        .selectExpr("*", f"__antes + {inside} AS {quoted(name)}")
        .drop("__bloque", "__antes")
    )


def day_carry_over_in_blocks(
    net: DataFrame,
    value: str,
    name: str = "neto_arrastrado",
    seed_hour: int = SEED_HOUR,
    days: int = BLOCK_DAYS,
) -> DataFrame:
    """``day_carry_over`` for calendars too long for one window an hour."""
    first_day = net.agg(F.min("fecha")).scalar()
    seed = (
        net.where(F.col("hora") == seed_hour)
        .agg(F.min_by(F.col(value), F.col("fecha")))
        .scalar()
    )
    later = net.where(F.col("fecha") > first_day)
    block = f"floor(unix_date(fecha) / {days})"
    summed = running_sum_in_blocks(later, value, "__suma", ["hora"], "fecha", block)
    return summed.select("fecha", "hora", (seed + F.col("__suma")).alias(name))
