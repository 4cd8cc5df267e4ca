"""All summary tables of a finished flow."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gateflow.functions.fixed import TIME_BANDS
from gateflow.operators.counts import COUNT, DIRECTION
from gateflow.operators.impute import correct_two_sigma, imputation_audit
from gateflow.operators.netflow import (
    closing_level,
    day_carry_over,
    net_by_band,
    net_by_hour,
    net_cumulative,
    net_wide,
)
from gateflow.operators.reshape import pivot_bands, pivot_hours, pivot_month_day
from gateflow.plans import marts
from gateflow.plans.flow import IMPUTED, IMPUTED_LEVEL
from gateflow.session import materialise

LEVEL = "conteo_acumulado"
RAW_NET = "diferencia"
CORRECTED = "conteo_corregido"


def report(
    tables: dict[str, DataFrame], direction: str = DIRECTION, bands=TIME_BANDS
) -> dict[str, DataFrame]:
    """Summary tables by name from the result of ``flow_tables``.

    All start from the stored imputed table, which has one row per date, direction and
    hour. Boxes of one value are computed together and stored, the carry-over has to know
    the first day; all else is lazy. A flow of counted exports has its result already.
    """
    if "imputed" not in tables:
        return {}
    imputed, net = tables["imputed"], tables["net"]
    keys = ["fecha", direction]
    dense = imputed.select(
        *keys, "hora", COUNT, LEVEL, "franja_horaria", "dia_sem", "tipo_dia"
    )
    known = dense.dropna(subset=["fecha"])
    labels = [label for label, _, _ in bands]
    raw_net = net_cumulative(dense, LEVEL, RAW_NET, direction, bands)
    corrected = correct_two_sigma(dense, COUNT, CORRECTED, direction)
    return {
        "imputation_audit": imputation_audit(imputed, COUNT, IMPUTED, direction),
        "counts_by_hour": pivot_hours(known, COUNT, keys, 0),
        "levels_by_hour": pivot_hours(known, LEVEL, keys),
        "imputed_levels_by_hour": pivot_hours(
            imputed.dropna(subset=["fecha"]), IMPUTED_LEVEL, keys
        ),
        "corrected_by_hour": pivot_hours(corrected, CORRECTED, keys),
        "corrected_by_band": marts.band_sums(corrected, CORRECTED, CORRECTED, direction),
        "closing_levels": pivot_bands(
            closing_level(dense, ["fecha", "tipo_dia", direction], LEVEL),
            ["fecha", "tipo_dia", direction],
            "conteo_final_franja",
            labels=labels,
        ),
        "day_carry_over": day_carry_over(
            materialise(net_by_hour(dense, LEVEL, RAW_NET, direction)), RAW_NET
        ),
        "net_by_hour": net_wide(imputed, IMPUTED_LEVEL, direction),
        "net_by_band": net_by_band(dense, LEVEL, direction, labels),
        "month_day": pivot_month_day(imputed, IMPUTED, direction),
        "net_profile": marts.net_profile(net),
        **marts.net_boxes(net),
        "net_heatmap": marts.net_heatmap(tables["hourly_net"]),
        "net_mean_band": marts.net_mean_band(raw_net, RAW_NET, labels),
        "net_sd_band": marts.net_sd_band(raw_net, RAW_NET, labels),
        "count_heatmap": marts.count_heatmap(dense, COUNT, direction),
        "count_profile": marts.hourly_profile(dense, COUNT, direction),
        "count_mean_band": marts.count_mean_band(dense, COUNT, direction, labels),
        "count_sd_band": marts.count_sd_band(dense, COUNT, direction, labels),
        **marts.count_boxes(imputed, IMPUTED, direction, labels),
        "variability": marts.variability(imputed, IMPUTED, direction),
        "band_totals": marts.band_totals(dense, direction=direction),
        "band_day_box": marts.band_day_box_working_days(
            dense, COUNT, direction, labels
        ),
        "entry_series": marts.entry_band_series(
            corrected, CORRECTED, direction, labels
        ),
        "entry_level_series": marts.entry_band_series(
            dense, LEVEL, direction, labels, skip_missing=True
        ),
    }
