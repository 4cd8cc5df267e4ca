"""SQL expressions shared by the operators.

Each function returns the text of one expression over the columns or
expressions it is given, for ``selectExpr`` and ``expr``. A long CASE then
costs one call from Python to the JVM instead of one per branch.
"""

from gateflow.functions.missing import (
    floor_at_zero,
    if_else,
    running_sum,
    strict_sum,
    strict_sum_where,
)
from gateflow.functions.timeparts import (
    band_rank,
    day_type,
    label_time,
    time_band,
    weekday_label,
    weekday_number,
)

__all__ = [
    "band_rank",
    "day_type",
    "floor_at_zero",
    "if_else",
    "label_time",
    "running_sum",
    "strict_sum",
    "strict_sum_where",
    "time_band",
    "weekday_label",
    "weekday_number",
]
