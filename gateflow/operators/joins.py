"""Joins with a small side, and with keys that may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions.text import name
from gateflow.session import materialise

# A table of more bytes than this is not broadcast.
BROADCAST_BYTES = 64 << 20
_FIXED_WIDTH = 16


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values: strings by length, nested ones by that of their text."""

    def width(column: str, kind: str) -> str:
        if kind in ("string", "binary"):
            return f"coalesce(octet_length({name(column)}), 0) + {_FIXED_WIDTH}"
        if kind.startswith(("array", "map", "struct")):
            return f"octet_length(to_json(struct({name(column)}))) + {_FIXED_WIDTH}"
        return str(_FIXED_WIDTH)

    widths = [width(column, kind) for column, kind in df.dtypes]
    return df.selectExpr(f"sum({' + '.join(widths)})").first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``df`` computed and measured, marked for broadcast if it is small.

    For a lookup that is joined with raw rows: measuring it first spares the
    raw rows a shuffle. A larger lookup is left to a shuffle join, in which
    adaptive execution splits the partition of a key that holds most rows.
    """
    limit = BROADCAST_BYTES if max_bytes is None else max_bytes
    stored = materialise(df)
    return F.broadcast(stored) if measured_bytes(stored) <= limit else stored


def left_join_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join on ``on``, key columns once, taken from the left.

    Meant for tables that grow with the calendar only. No broadcast is forced:
    adaptive execution measures the right side and broadcasts it if it is
    small, otherwise it splits skewed left partitions.
    """
    taken = {key: f"__{key}" for key in on}
    matches = " AND ".join(f"{name(k)} <=> {name(t)}" for k, t in taken.items())
    joined = left.join(right.withColumnsRenamed(taken), F.expr(matches), "left")
    return joined.drop(*taken.values())
