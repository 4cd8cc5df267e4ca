"""Counters of a load, taken in the job that writes its rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gateflow.sources.workbooks import Layout


def tallied(
    rows: DataFrame, layout: Layout, gates: Iterable[str] | None, tally: Observation
) -> DataFrame:
    """``rows``, whose counts are in ``tally.get`` once an action has read them all.

    ``rows`` counts all of good files, ``refused`` files that could not be read,
    ``untimed`` rows without a time that can be read, ``kept`` rows of the wanted gates
    (of all gates if ``gates`` is None), with their first and last date.
    """
    good = F.col("load_error").isNull()
    moment = F.col(layout.timestamp)
    kept = good & moment.isNotNull()
    if layout.gate is not None and gates is not None:
        kept &= F.col(layout.gate).isin(list(gates))
    day = F.when(kept, F.to_date(moment))
    return rows.observe(
        tally,
        F.count_if(good).alias("rows"),
        F.count_if(~good).alias("refused"),
        F.count_if(good & moment.isNull()).alias("untimed"),
        F.count_if(kept).alias("kept"),
        F.min(day).alias("first"),
        F.max(day).alias("last"),
    )
