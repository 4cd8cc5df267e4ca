"""Labels derived from a date and an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gateflow.functions.fixed import BAND_LABELS, DAY_TYPES, TIME_BANDS, WEEKDAY_LABELS
from gateflow.functions.text import name, value


def _range_label(number: str, ranges) -> str:
    """Label of the range that holds the number, NULL outside all of them."""
    cases = " ".join(
        f"WHEN {number} BETWEEN {first} AND {last} THEN {value(label)}"
        for label, first, last in ranges
    )
    return f"CASE {cases} END"


def time_band(hora: str, bands=TIME_BANDS) -> str:
    return _range_label(hora, bands)


def band_rank(franja: str, labels=BAND_LABELS) -> str:
    """Position of the band within the day, from 1."""
    cases = " ".join(f"WHEN {value(n)} THEN {rank}" for rank, n in enumerate(labels, 1))
    return f"CASE {franja} {cases} END"


def weekday_number(fecha: str) -> str:
    """Monday is 1, Sunday is 7."""
    return f"weekday({fecha}) + 1"


def day_type(fecha: str, day_types=DAY_TYPES) -> str:
    return _range_label(f"({weekday_number(fecha)})", day_types)


def weekday_label(fecha: str, labels=WEEKDAY_LABELS) -> str:
    """Label of the weekday, NULL for days past the end of ``labels``."""
    return f"get(array({', '.join(map(value, labels))}), weekday({fecha}))"


def label_time(
    df: DataFrame, fecha: str = "fecha", hora: str = "hora", bands=TIME_BANDS
) -> DataFrame:
    """Add the band of the hour, the weekday number and the day type."""
    return df.selectExpr(
        "*",
        f"{time_band(name(hora), bands)} AS franja_horaria",
        f"{weekday_number(name(fecha))} AS dia_sem",
        f"{day_type(name(fecha))} AS tipo_dia",
    )
