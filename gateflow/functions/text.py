"""Names and values as SQL text."""

from __future__ import annotations


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def names(columns: list[str]) -> str:
    return ", ".join(map(name, columns))


def value(constant: object) -> str:
    if constant is None:
        return "NULL"
    if isinstance(constant, str):
        return "'" + constant.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(constant, float):
        return f"{float(constant)!r}D"
    return str(constant)
