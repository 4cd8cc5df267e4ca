"""Expressions in which a missing input gives a missing output.

Spark skips NULL in sums and sends a NULL condition to ELSE; the results
matched here are those of a language where NA spreads.
"""

from __future__ import annotations

from gateflow.functions.text import names


def if_else(condition: str, yes: str, no: str) -> str:
    """``yes`` or ``no`` by the condition; NULL where the condition is NULL."""
    return f"CASE WHEN {condition} THEN {yes} WHEN NOT ({condition}) THEN {no} END"


def floor_at_zero(value: str) -> str:
    """Negative values become 0, NULL stays NULL."""
    return f"CASE WHEN {value} < 0 THEN 0D ELSE {value} END"


def strict_sum(value: str) -> str:
    """Sum that is NULL as soon as one value is NULL."""
    return f"CASE WHEN count({value}) = count(1) THEN sum({value}) END"


def strict_sum_where(value: str, hit: str, fill: str | None = None) -> str:
    """Strict sum of the rows that ``hit`` holds for; ``fill`` if there is none."""
    only = f"FILTER (WHERE {hit})"
    found = f"CASE WHEN count({value}) {only} = count(1) {only} THEN sum({value}) {only} END"
    if fill is None:
        return found
    return f"CASE WHEN count(1) {only} = 0 THEN {fill} ELSE {found} END"


def running_sum(value: str, partition: list[str], order: str) -> str:
    """Running sum that stays NULL from the first NULL value on."""
    over = (
        f"OVER (PARTITION BY {names(partition)} ORDER BY {order} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    complete = f"count({value}) {over} = count(1) {over}"
    return f"CASE WHEN {complete} THEN sum({value}) {over} END"
