"""Names, types and row ranges of loaded tables. All steps are narrow or
combined on the map side; none moves whole rows to find something out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateflow.operators.joins import broadcast_if_small
from gateflow.sources.names import clean_names as cleaned


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case ASCII column names; changes no data."""
    return df.toDF(*cleaned(df.columns))


def rename_third(df: DataFrame, name: str = "operator") -> DataFrame:
    """The third column, if there is one, is called ``name``."""
    names = list(df.columns)
    if len(names) >= 3:
        names[2] = name
    return df.toDF(*names)


def parse_timestamp(text: Column) -> Column:
    """Date and time from text; unreadable text gives NULL.

    Takes year-month-day with ``-``, ``/`` or ``.``, with or without a time,
    and bare numbers as seconds since 1970. The session time zone plays no
    part.
    """
    trimmed = F.trim(text)
    dashed = F.regexp_replace(
        trimmed, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3"
    )
    seconds = trimmed.try_cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(
        trimmed.rlike(r"^[+-]?\d+(\.\d+)?$"),
        epoch + F.make_dt_interval(secs=seconds),
    ).otherwise(dashed.try_cast("timestamp_ntz"))


def _typed(df: DataFrame, name: str, wanted: str) -> Column:
    if wanted == "timestamp_ntz" and df.schema[name].dataType.typeName() == "string":
        return parse_timestamp(F.col(name))
    return F.col(name).try_cast(wanted)


def conform_types(
    df: DataFrame, types: dict[str, str], strict: bool = False
) -> DataFrame:
    """Cast the columns of ``types`` that are present; bad values become NULL.

    ``strict`` makes an absent column an error.
    """
    absent = [name for name in types if name not in df.columns]
    if strict and absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.withColumns(
        {n: _typed(df, n, t) for n, t in types.items() if n in df.columns}
    )


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, absent columns filled with NULL."""
    return reduce(
        lambda top, bottom: top.unionByName(bottom, allowMissingColumns=True), frames
    )


def sentinel_cut(
    df: DataFrame, source: str, position: str, is_marker: Column
) -> DataFrame:
    """Rows before the first marker of their source; all rows if it has none.

    Only the marker positions are grouped, one value per source and task, and
    the cuts are joined back, so that the rows of a source need not meet.
    """
    cuts = broadcast_if_small(
        df.where(is_marker)
        .groupBy(F.col(source).alias("__source"))
        .agg(F.min(position).alias("__cut"))
    )
    kept = F.col("__cut").isNull() | (F.col(position) < F.col("__cut"))
    return (
        df.join(cuts, F.col(source).eqNullSafe(F.col("__source")), "left")
        .where(kept)
        .drop("__source", "__cut")
    )


def split_quarantine(
    df: DataFrame, error: str = "load_error"
) -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and the rows that carry an error."""
    good = df.where(F.col(error).isNull()).drop(error)
    return good, df.where(F.col(error).isNotNull())


def preview(
    df: DataFrame, columns: list[str], order: list[str], n: int = 6
) -> DataFrame:
    """First ``n`` rows in a stated order; a top-n, not a full sort."""
    return df.orderBy(*order).limit(n).select(*columns)
