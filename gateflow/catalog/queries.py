"""One query per operator, summary table and flow, on the given tables.

Doubles are rounded here, and only here, so that the order of summation does
not show when results are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.catalog.adapter import new_format, precounted, table, transactions
from gateflow.functions import (
    label_time,
    time_band,
    weekday_label,
    weekday_number,
)
from gateflow.operators import (
    blocks,
    calendar,
    counts,
    impute,
    increments,
    moments,
    netflow,
    reshape,
    selection,
    stats,
)
from gateflow.operators.counts import COUNT, DIRECTION
from gateflow.plans import flow, marts
from gateflow.plans.flow import IMPUTED, IMPUTED_LEVEL, NET
from gateflow.session import materialise
from gateflow.sources import conform, ledger, workbooks

Query = Callable[[SparkSession, str], DataFrame]

LEVEL = "conteo_acumulado"
RAW_NET = "diferencia"
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to ``DIGITS`` decimals, with a single zero."""
    return df.selectExpr(
        *[
            f"round(`{name}`, {DIGITS}) + 0D AS `{name}`"
            if kind == "double"
            else f"`{name}`"
            for name, kind in df.dtypes
        ]
    )


# Inputs shared by the queries -------------------------------------------------


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts, lazily: for queries that read them once."""
    return transactions(spark, folder).transform(counts.keep_gates).transform(
        counts.count_hourly
    )


def dated(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted transactions with their date and hour."""
    wanted = transactions(spark, folder).transform(counts.keep_gates)
    return wanted.transform(counts.with_date_hour)


def stored_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return flow.hourly_counts(transactions(spark, folder))


def dense(spark: SparkSession, folder: str) -> DataFrame:
    return calendar.dense_table(stored_hourly(spark, folder))


def imputed(spark: SparkSession, folder: str) -> DataFrame:
    return flow.imputed_table(stored_hourly(spark, folder))


def corrected(spark: SparkSession, folder: str) -> DataFrame:
    return dense(spark, folder).transform(impute.correct_two_sigma)


def net(spark: SparkSession, folder: str) -> DataFrame:
    return netflow.net_cumulative(imputed(spark, folder), IMPUTED_LEVEL, NET)


def raw_net(spark: SparkSession, folder: str) -> DataFrame:
    return netflow.net_cumulative(dense(spark, folder), LEVEL, RAW_NET)


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    """All transactions as rows of sheets with two kinds of header, typed.

    Every 50th has a time that cannot be read.
    """
    one = ["tema_key", "transaction_date", DIRECTION, "transit_status_description"]
    one += ["card_number"]
    two = ["card_number", "other", *one[3:0:-1], "tema_key", "parameter_1"]
    moment = "IF(event_id % 50 = 7, 'n/a', CAST(transaction_date AS STRING))"

    def cells(columns: list[str]) -> str:
        parts = {"transaction_date": moment, "other": "'x'", "parameter_1": "NULL"}
        return f"array({', '.join(parts.get(c, c) for c in columns)})"

    def header(columns: list[str]) -> str:
        return f"array({', '.join(repr(c) for c in columns)})"

    first = "event_id % 40 < 20"
    sheets = transactions(spark, folder).selectExpr(
        "concat('file-', event_id % 40, '.xlsx') AS source_path",
        "event_id AS row_idx",
        f"IF({first}, {header(one)}, {header(two)}) AS columns",
        f"IF({first}, {cells(one)}, {cells(two)}) AS cells",
        "CAST(NULL AS STRING) AS load_error",
    )
    texts = workbooks.cells_by_name(sheets, workbooks.OLD_EXPORT)
    return workbooks.type_records(texts, workbooks.OLD_EXPORT)


def holed(spark: SparkSession, folder: str) -> DataFrame:
    """The full calendar with missing values, and days with entries alone."""
    rows = dense(spark, folder).where(
        f"NOT ({DIRECTION} = 'Exit' AND dayofmonth(fecha) % 5 = 0)"
    )
    hole = f"hora % 7 = 3 AND {DIRECTION} = 'Entry'"
    return rows.selectExpr("*", f"IF({hole}, NULL, {COUNT}) AS valor")


# Sources ----------------------------------------------------------------------


def records_typed(spark: SparkSession, folder: str) -> DataFrame:
    good, _ = conform.split_quarantine(loaded(spark, folder))
    return good


def records_counts(spark: SparkSession, folder: str) -> DataFrame:
    return (
        records_typed(spark, folder)
        .transform(counts.keep_gates)
        .transform(counts.count_hourly)
    )


def densify_missing_times(spark: SparkSession, folder: str) -> DataFrame:
    return calendar.densify_hours(materialise(records_counts(spark, folder)))


def clean_names(spark: SparkSession, folder: str) -> DataFrame:
    messy = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Customer Key (N°)"),
        F.col("c_name").alias("C.Name"),
        F.col("c_nationkey").alias("NaciónKey"),
        F.col("c_acctbal").alias("% of Balance"),
        F.col("c_name").alias("c name"),
        F.col("c_custkey").alias("2nd key"),
        F.col("c_nationkey").alias("C Name 2"),
        F.col("c_nationkey").alias("Straße Æ"),
    )
    return conform.clean_names(messy)


def rename_third(spark: SparkSession, folder: str) -> DataFrame:
    return conform.rename_third(
        table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    )


def sentinel_cut(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    is_marker = F.col("event_type") == "error"
    return conform.sentinel_cut(events, "user_id", "event_id", is_marker)


_PROPS = {"k": "bigint", "event_type": "double", "value": "string", "absent": "string"}


def conform_types(spark: SparkSession, folder: str) -> DataFrame:
    number = F.get_json_object("props", "$.k").alias("k")
    return (
        table(spark, folder, "events")
        .select("event_id", number, "event_type", F.col("ts").cast("string").alias("t"))
        .transform(conform.conform_types, {**_PROPS, "t": "timestamp_ntz"})
    )


def quarantine_split(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose type is not a number, by the split on an error column."""
    text = F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k"))
    checked = (
        table(spark, folder, "events")
        .select("event_id", F.coalesce(text, "event_type").alias("texto"))
        .withColumn("numero", F.col("texto").try_cast("bigint"))
        .withColumn("load_error", F.when(F.col("numero").isNull(), F.col("texto")))
    )
    good, bad = conform.split_quarantine(checked)
    return conform.union_by_name(good, bad)


def union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return conform.union_by_name(
        orders.select("o_orderkey", "o_custkey", "o_orderstatus"),
        orders.select("o_orderstatus", "o_orderkey", "o_totalprice"),
    )


def preview(spark: SparkSession, folder: str) -> DataFrame:
    shown = ["fecha", "hora", DIRECTION, COUNT, LEVEL]
    return conform.preview(dense(spark, folder), shown, ["fecha", "hora", DIRECTION])


# Filters, calendar, joins -----------------------------------------------------


def gate_filter(spark: SparkSession, folder: str) -> DataFrame:
    return transactions(spark, folder).transform(counts.keep_gates)


def gate_table(spark: SparkSession, folder: str) -> DataFrame:
    """Gates that met more errors than signups, kept through a semi join."""
    seen = transactions(spark, folder)
    status = F.col("transit_status_description")
    troubled = (
        seen.groupBy("tema_key")
        .agg(F.count_if(status == "error").alias("e"), F.count_if(status == "signup").alias("s"))
        .where("e > s")
        .select("tema_key")
    )
    return seen.transform(counts.keep_gates, troubled).transform(counts.count_hourly)


def new_format_counts(spark: SparkSession, folder: str) -> DataFrame:
    return (
        new_format(spark, folder)
        .transform(counts.keep_gates, key="name")
        .transform(counts.count_hourly, "sap_transit_flag", "operator")
    )


def drop_null_key(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of labelled gates only: unlisted gates have no label."""
    label = F.when(F.col("tema_key") != "TK99RT99", F.col("tema_key"))
    return (
        transactions(spark, folder)
        .withColumn("puerta", label)
        .transform(counts.drop_missing, "puerta")
        .groupBy("puerta", DIRECTION)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def calendar_grid(spark: SparkSession, folder: str) -> DataFrame:
    return stored_hourly(spark, folder).transform(calendar.calendar_grid)


def densify_hours(spark: SparkSession, folder: str) -> DataFrame:
    return stored_hourly(spark, folder).transform(calendar.densify_hours)


def densify_listed(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar of two listed directions, which needs no join."""
    sides = ["Entry", "Exit"]
    return stored_hourly(spark, folder).transform(
        calendar.densify_hours, directions=sides
    )


def attach_group_stats(spark: SparkSession, folder: str) -> DataFrame:
    groups = impute.stats_groups()
    attached = dense(spark, folder).transform(impute.attach_group_stats, groups)
    return attached.select(
        "fecha", "hora", *groups, COUNT, "mu", "sigma", "limite_inferior",
        "limite_superior",
    )


def attach_day_attributes(spark: SparkSession, folder: str) -> DataFrame:
    bare = netflow.net_by_hour(dense(spark, folder), LEVEL, RAW_NET)
    return label_time(bare)


def full_outer_net(spark: SparkSession, folder: str) -> DataFrame:
    sides = netflow.full_outer_sides(hourly(spark, folder), COUNT)
    return netflow.net_of_sides(sides)


def select_by_pattern(spark: SparkSession, folder: str) -> DataFrame:
    """The entry columns of both sides, as numbers."""
    sides = netflow.full_outer_sides(hourly(spark, folder), COUNT)
    entries = reshape.by_name_pattern(sides, suffix="_Entry")
    return reshape.as_numeric(entries, entries.columns)


def net_cumulative_wide(spark: SparkSession, folder: str) -> DataFrame:
    return netflow.net_wide(dense(spark, folder))


# Aggregations and windows -----------------------------------------------------


def sum_in_out(spark: SparkSession, folder: str) -> DataFrame:
    return precounted(spark, folder).transform(counts.sum_in_out)


def adjust_net_people(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(sum_in_out(spark, folder)).transform(impute.adjust_net_people)


def band_totals(spark: SparkSession, folder: str) -> DataFrame:
    return marts.band_totals(dense(spark, folder))


def corrected_band_sum(spark: SparkSession, folder: str) -> DataFrame:
    name = "conteo_corregido"
    return marts.band_sums(corrected(spark, folder), name, name)


def band_cumsum_sum(spark: SparkSession, folder: str) -> DataFrame:
    return marts.band_sums(dense(spark, folder), LEVEL, LEVEL, skip_missing=True)


def band_sum_missing_values(spark: SparkSession, folder: str) -> DataFrame:
    """Sums per band, strict and over what is there."""
    rows = holed(spark, folder)
    strict = marts.band_sums(rows, "valor", "estricta")
    loose = marts.band_sums(rows, "valor", "presente", skip_missing=True)
    return strict.join(loose, ["fecha", DIRECTION, "franja_horaria"])


def band_closing_level(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["fecha", "tipo_dia", DIRECTION]
    return netflow.closing_level(dense(spark, folder), keys)


def group_mean_sd(spark: SparkSession, folder: str) -> DataFrame:
    return impute.group_mean_sd(dense(spark, folder), impute.stats_groups())


def two_sigma_limits(spark: SparkSession, folder: str) -> DataFrame:
    return group_mean_sd(spark, folder).transform(impute.two_sigma_limits)


def local_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return stats.local_percentiles(dense(spark, folder), impute.stats_groups(), COUNT)


def boxplot_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.boxplot_stats(dense(spark, folder), impute.stats_groups(), COUNT)


def boxplot_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return stats.boxplot_outliers(dense(spark, folder), impute.stats_groups(), COUNT)


def date_range(spark: SparkSession, folder: str) -> DataFrame:
    return counts.date_range(dated(spark, folder))


def distinct_days(spark: SparkSession, folder: str) -> DataFrame:
    labelled = dated(spark, folder).transform(label_time)
    return counts.distinct_rows(labelled, "fecha", "tipo_dia")


def cumulative_in_day(spark: SparkSession, folder: str) -> DataFrame:
    return densify_hours(spark, folder).transform(calendar.accumulate)


def cumulative_imputed(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["fecha", DIRECTION, "hora", IMPUTED, IMPUTED_LEVEL]
    return imputed(spark, folder).select(*columns)


def cumulative_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return hourly(spark, folder).transform(calendar.accumulate)


def day_carry_over(spark: SparkSession, folder: str) -> DataFrame:
    levels = materialise(
        netflow.net_by_hour(dense(spark, folder), LEVEL, RAW_NET)
    )
    return netflow.day_carry_over(levels, RAW_NET)


def day_carry_over_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The carry-over in blocks of a week."""
    levels = materialise(netflow.net_by_hour(dense(spark, folder), LEVEL, RAW_NET))
    return blocks.day_carry_over_in_blocks(levels, RAW_NET, days=7)


def running_sum_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Running sum over all events of a kind; a click without a sum ends its own."""
    events = table(spark, folder, "events").selectExpr(
        "event_type", "event_id", "IF(event_type = 'click' AND event_id % 500 = 499, NULL, "
        "CAST(user_id AS BIGINT)) AS valor"
    )
    return blocks.running_sum_in_blocks(
        events, "valor", "suma", ["event_type"], "event_id", "event_id div 256"
    )


# Increments -------------------------------------------------------------------


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions as rows of 40 files."""
    return transactions(spark, folder).selectExpr(
        "concat('file-', event_id % 40) AS source_path", "event_id % 40 AS f", "*"
    )


# Files that a second run finds as they were, new, touched only, and gone.
_SAME, _NEW, _TOUCHED, _GONE = "f % 5 = 0", "f % 7 = 3", "f % 11 = 1", "f % 13 = 6"
_EARLY = "dayofmonth(transaction_date) <= 20"


def ledger_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What a second look at the files finds."""

    def listed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("source_path").alias("path")).agg(
            F.expr("count(1) AS length"),
            F.expr(f"max(transaction_date) + max(IF({_TOUCHED}, late, INTERVAL '0' DAY)) AS modified"),
            F.expr("CAST(sum(event_id) AS STRING) AS digest"),
        )

    files = _files(spark, folder)
    before = files.where(f"NOT ({_NEW}) AND ({_SAME} OR {_TOUCHED} OR {_GONE} OR {_EARLY})")
    now = files.where(f"{_NEW} OR NOT ({_GONE})")
    return ledger.file_changes(
        listed(now.selectExpr("*", "INTERVAL '1' DAY AS late")),
        listed(before.selectExpr("*", "INTERVAL '0' DAY AS late")),
    )


def ledger_live_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the files' own batches, out of those of two runs."""
    files = _files(spark, folder)
    first = files.where(f"NOT ({_NEW})").selectExpr("*", "'a' AS batch")
    second = files.where(f"{_NEW} OR NOT ({_SAME})").selectExpr("*", "'b' AS batch")
    named = files.where(f"{_NEW} OR NOT ({_GONE})").selectExpr(
        "source_path AS path", f"IF({_SAME} AND NOT ({_NEW}), 'a', 'b') AS batch"
    )
    rows = first.where(_EARLY).unionAll(second)
    return ledger.live_rows(rows, named.distinct()).select("event_id", "source_path", "batch")


def counts_taken_back(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts after files came, changed and went, by their parts alone."""
    files = _files(spark, folder).transform(counts.keep_gates)
    keys = ["source_path", "f"]
    parts = materialise(
        increments.count_by_source(files.where(f"NOT ({_NEW})").where(_EARLY), keys)
    )
    totals = increments.merge_counts(parts.drop("source_path", "f"))
    renewed = f"{_NEW} OR NOT ({_SAME} OR {_GONE})"
    new_parts = increments.count_by_source(files.where(renewed), keys).drop("f")
    old_parts = parts.where(f"NOT ({_NEW}) AND (NOT ({_SAME}) OR {_GONE})").drop("f")
    return increments.refreshed_totals(totals, old_parts, new_parts)


def merged_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Limits from the states of three disjoint batches of days."""
    groups = impute.stats_groups()
    rows = materialise(dense(spark, folder))
    states = [
        moments.moment_states(rows.where(f"dayofmonth(fecha) % 3 = {i}"), ["fecha", *groups])
        for i in range(3)
    ]
    merged = moments.merge_moments(groups, *states)
    return moments.mean_sd_of_states(merged).transform(impute.two_sigma_limits)


def renewed_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Limits from stored states of days, some of which were counted anew."""
    groups = impute.stats_groups()
    rows = materialise(dense(spark, folder))
    late = "dayofmonth(fecha) % 4 = 0"
    stored = moments.moment_states(rows.where(f"NOT ({late}) OR hora < 9"), ["fecha", *groups])
    renewed = moments.moment_states(rows.where(late), ["fecha", *groups])
    states = moments.replace_states(stored, materialise(renewed))
    merged = moments.merge_moments(groups, states)
    return moments.mean_sd_of_states(merged).transform(impute.two_sigma_limits)


def exact_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the value of all events, by kind, from histograms of 64 bins."""
    shares = {"p01": 0.01, "mediana": 0.5, "p75": 0.75, "p999": 0.999}
    events = table(spark, folder, "events")
    return selection.exact_percentiles(events, ["event_type"], "value", shares, 64)


def boxplot_large_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialise(dense(spark, folder))
    return selection.boxplot_of_large_groups(rows, impute.stats_groups(), COUNT)


def boxplot_distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes over the values of all events, most of them distinct."""
    events = table(spark, folder, "events")
    return selection.boxplot_of_large_groups(events, ["event_type"], "value", local_points=True)


def dense_placed(spark: SparkSession, folder: str) -> DataFrame:
    """The dense table from counts stored by date and direction."""
    return calendar.dense_table_of_placed(calendar.place_counts(stored_hourly(spark, folder)))


def pivot_placed(spark: SparkSession, folder: str) -> DataFrame:
    known = dense_placed(spark, folder).transform(counts.drop_missing, "fecha")
    return reshape.pivot_hours(known, LEVEL)


# Reshape ----------------------------------------------------------------------


def pivot_cumulative(spark: SparkSession, folder: str) -> DataFrame:
    known = dense(spark, folder).transform(counts.drop_missing, "fecha")
    return reshape.pivot_hours(known, LEVEL)


def pivot_imputed_cumulative(spark: SparkSession, folder: str) -> DataFrame:
    known = imputed(spark, folder).transform(counts.drop_missing, "fecha")
    return reshape.pivot_hours(known, IMPUTED_LEVEL)


def pivot_missing_values(spark: SparkSession, folder: str) -> DataFrame:
    """Cells without a row are 0, cells with a missing value stay missing."""
    rows = holed(spark, folder).where("NOT (hora = 5 AND dayofmonth(fecha) % 2 = 0)")
    return reshape.pivot_hours(rows, "valor", fill=0)


def pivot_counts(spark: SparkSession, folder: str) -> DataFrame:
    known = dense(spark, folder).transform(counts.drop_missing, "fecha")
    return reshape.pivot_hours(known, COUNT, fill=0)


def pivot_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return hourly(spark, folder).transform(reshape.pivot_hours, COUNT)


def pivot_bands(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.pivot_bands(dense(spark, folder), ["fecha", DIRECTION], LEVEL)


def pivot_band_totals(spark: SparkSession, folder: str) -> DataFrame:
    ids = ["tipo_dia", DIRECTION]
    return reshape.pivot_bands(band_totals(spark, folder), ids, "conteo_total_franja")


def pivot_corrected_bands(spark: SparkSession, folder: str) -> DataFrame:
    ids = ["fecha", DIRECTION]
    return reshape.pivot_bands(
        corrected_band_sum(spark, folder), ids, "conteo_corregido"
    )


def pivot_band_levels(spark: SparkSession, folder: str) -> DataFrame:
    ids = ["fecha", DIRECTION]
    return reshape.pivot_bands(band_cumsum_sum(spark, folder), ids, LEVEL)


def pivot_month_day(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.pivot_month_day(imputed(spark, folder), IMPUTED)


def pivot_corrected_hours(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.pivot_hours(corrected(spark, folder), "conteo_corregido")


def unpivot_hours(spark: SparkSession, folder: str) -> DataFrame:
    wide = net_cumulative_wide(spark, folder)
    return reshape.unpivot_hours(wide, ["fecha"], RAW_NET)


# Labels and imputation --------------------------------------------------------


def time_band_counts(spark: SparkSession, folder: str) -> DataFrame:
    band = F.expr(f"{time_band('hour(transaction_date)')} AS franja_horaria")
    return transactions(spark, folder).groupBy(band).agg(F.count(F.lit(1)).alias("n"))


def day_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    labelled = transactions(spark, folder).transform(counts.with_date_hour)
    return (
        label_time(labelled)
        .groupBy("fecha", "dia_sem", "tipo_dia")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def weekday_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    label = F.expr(f"{weekday_label('transaction_date')} AS dia_ordenado")
    order = F.expr(f"{weekday_number('transaction_date')} AS dia_orden")
    seen = transactions(spark, folder)
    return seen.groupBy(label, order).agg(F.count(F.lit(1)).alias("n"))


def impute_two_sigma(spark: SparkSession, folder: str) -> DataFrame:
    return dense(spark, folder).transform(impute.impute_two_sigma)


def impute_one_row_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The first hour of each day in a group of its own: no sigma, no value."""
    way = f"IF(hora = 0, concat({DIRECTION}, '-', fecha), {DIRECTION})"
    rows = dense(spark, folder).withColumn(DIRECTION, F.expr(way))
    return impute.impute_two_sigma(rows).select(
        "fecha", DIRECTION, "hora", "mu", "sigma", IMPUTED
    )


def impute_on_the_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of hours, with limits that fall on both of their values."""
    way = f"concat_ws('-', {DIRECTION}, fecha, hora div 2)"
    rows = dense(spark, folder).withColumn(DIRECTION, F.expr(way))
    return impute.impute_two_sigma(rows, sigmas=0.5**0.5).select(
        "fecha", DIRECTION, "hora", IMPUTED
    )


def correct_two_sigma(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["fecha", DIRECTION, "hora", COUNT, "conteo_corregido"]
    return corrected(spark, folder).select(*columns)


def imputation_audit(spark: SparkSession, folder: str) -> DataFrame:
    return impute.imputation_audit(imputed(spark, folder))


# Net flow ---------------------------------------------------------------------


def net_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return netflow.net_hourly(imputed(spark, folder), IMPUTED)


def net_hourly_raw(spark: SparkSession, folder: str) -> DataFrame:
    return netflow.net_hourly(dense(spark, folder), COUNT)


def net_missing_values(spark: SparkSession, folder: str) -> DataFrame:
    return netflow.net_by_hour(holed(spark, folder), "valor", RAW_NET)


def net_by_band(spark: SparkSession, folder: str) -> DataFrame:
    return netflow.net_by_band(dense(spark, folder))


def net_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return netflow.net_by_hour(hourly(spark, folder), COUNT, RAW_NET, fill=None)


# Summary tables ---------------------------------------------------------------


def _mart(build: Callable[..., DataFrame], source: Query, *args) -> Query:
    return lambda spark, folder: build(source(spark, folder), *args)


def entry_level_series(spark: SparkSession, folder: str) -> DataFrame:
    return marts.entry_band_series(dense(spark, folder), LEVEL, skip_missing=True)


def _box_set(build: Callable, source: Query, name: str) -> Query:
    return lambda spark, folder: build(materialise(source(spark, folder)))[name]


MARTS: dict[str, Query] = {
    "mart_sets_net_box_hour": _box_set(marts.net_boxes, net, "net_box_hour"),
    "mart_sets_net_box_weekday": _box_set(marts.net_boxes, net, "net_box_weekday"),
    "mart_sets_count_box_weekday": _box_set(marts.count_boxes, imputed, "count_box_weekday"),
    "mart_sets_band_box_lv": _box_set(marts.count_boxes, imputed, "band_box"),
    "mart_sets_pooled_band_day_lv": _box_set(
        marts.count_boxes, imputed, "pooled_band_day_box"
    ),
    "mart_net_profile": _mart(marts.net_profile, net),
    "mart_net_box_hour": _mart(marts.net_box_hour, net),
    "mart_count_heatmap": _mart(marts.count_heatmap, dense),
    "mart_net_heatmap": _mart(marts.net_heatmap, net_hourly),
    "mart_variability": _mart(marts.variability, imputed),
    "mart_variability_raw": _mart(marts.variability, dense, COUNT),
    "mart_count_box_weekday": _mart(marts.count_box_weekday, imputed),
    "mart_count_box_weekday_raw": _mart(marts.count_box_weekday, dense, COUNT),
    "mart_net_box_weekday": _mart(marts.net_box_weekday, net),
    "mart_band_box_lv": _mart(marts.band_box_working_days, imputed),
    "mart_band_day_box_lv": _mart(marts.band_day_box_working_days, dense),
    "mart_pooled_band_day_lv": _mart(marts.pooled_band_day_working_days, imputed),
    "mart_entry_band_series": _mart(
        marts.entry_band_series, corrected, "conteo_corregido"
    ),
    "mart_entry_band_series_level": entry_level_series,
    "mart_net_mean_band": _mart(marts.net_mean_band, raw_net, RAW_NET),
    "mart_net_sd_band": _mart(marts.net_sd_band, raw_net, RAW_NET),
    "mart_count_mean_band": _mart(marts.count_mean_band, dense),
    "mart_count_sd_band": _mart(marts.count_sd_band, dense),
}

OPERATORS: dict[str, Query] = {
    "op_records_typed": records_typed,
    "op_records_counts": records_counts,
    "op_densify_missing_times": densify_missing_times,
    "op_clean_names": clean_names,
    "op_rename_third": rename_third,
    "op_sentinel_cut": sentinel_cut,
    "op_conform_types": conform_types,
    "op_quarantine_split": quarantine_split,
    "op_union_by_name": union_by_name,
    "op_preview": preview,
    "op_gate_filter": gate_filter,
    "op_gate_table": gate_table,
    "op_drop_null_key": drop_null_key,
    "op_calendar_grid": calendar_grid,
    "op_densify_hours": densify_hours,
    "op_densify_listed_directions": densify_listed,
    "op_attach_group_stats": attach_group_stats,
    "op_attach_day_attributes": attach_day_attributes,
    "op_full_outer_net": full_outer_net,
    "op_select_by_pattern": select_by_pattern,
    "op_net_cumulative_wide": net_cumulative_wide,
    "op_count_hourly": hourly,
    "op_count_hourly_new_format": new_format_counts,
    "op_sum_in_out": sum_in_out,
    "op_band_totals": band_totals,
    "op_corrected_band_sum": corrected_band_sum,
    "op_band_cumsum_sum": band_cumsum_sum,
    "op_band_sum_missing_values": band_sum_missing_values,
    "op_band_closing_level": band_closing_level,
    "op_hourly_profile": _mart(marts.hourly_profile, dense),
    "op_group_mean_sd": group_mean_sd,
    "op_two_sigma_limits": two_sigma_limits,
    "op_local_percentiles": local_percentiles,
    "op_boxplot_stats": boxplot_stats,
    "op_boxplot_outliers": boxplot_outliers,
    "op_date_range": date_range,
    "op_distinct_days": distinct_days,
    "op_cumulative_in_day": cumulative_in_day,
    "op_cumulative_imputed": cumulative_imputed,
    "op_cumulative_sparse": cumulative_sparse,
    "op_day_carry_over": day_carry_over,
    "op_day_carry_over_blocks": day_carry_over_blocks,
    "op_running_sum_blocks": running_sum_blocks,
    "op_ledger_changes": ledger_changes,
    "op_ledger_live_rows": ledger_live_rows,
    "op_counts_taken_back": counts_taken_back,
    "op_merged_statistics": merged_statistics,
    "op_renewed_statistics": renewed_statistics,
    "op_exact_percentiles": exact_percentiles,
    "op_boxplot_large_groups": boxplot_large_groups,
    "op_boxplot_distinct_values": boxplot_distinct_values,
    "op_dense_placed": dense_placed,
    "op_pivot_placed": pivot_placed,
    "op_pivot_cumulative": pivot_cumulative,
    "op_pivot_imputed_cumulative": pivot_imputed_cumulative,
    "op_pivot_missing_values": pivot_missing_values,
    "op_pivot_counts": pivot_counts,
    "op_pivot_sparse": pivot_sparse,
    "op_pivot_bands": pivot_bands,
    "op_pivot_band_totals": pivot_band_totals,
    "op_pivot_corrected_bands": pivot_corrected_bands,
    "op_pivot_band_levels": pivot_band_levels,
    "op_pivot_month_day": pivot_month_day,
    "op_pivot_corrected_hours": pivot_corrected_hours,
    "op_unpivot_hours": unpivot_hours,
    "op_time_band": time_band_counts,
    "op_day_type": day_type_counts,
    "op_weekday_label": weekday_label_counts,
    "op_impute_two_sigma": impute_two_sigma,
    "op_impute_one_row_groups": impute_one_row_groups,
    "op_impute_on_the_limit": impute_on_the_limit,
    "op_correct_two_sigma": correct_two_sigma,
    "op_adjust_net_people": adjust_net_people,
    "op_imputation_audit": imputation_audit,
    "op_net_cumulative_imputed": net,
    "op_net_cumulative_raw": raw_net,
    "op_net_hourly": net_hourly,
    "op_net_hourly_raw": net_hourly_raw,
    "op_net_by_band": net_by_band,
    "op_net_sparse": net_sparse,
    "op_net_missing_values": net_missing_values,
}


def flow_end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions to the imputed occupancy curve."""
    return flow.occupancy(transactions(spark, folder))


def flow_dense(spark: SparkSession, folder: str) -> DataFrame:
    """The full imputed table of the flow."""
    tables = flow.flow_tables(transactions(spark, folder))
    return tables["imputed"]


def flow_new_format(spark: SparkSession, folder: str) -> DataFrame:
    """The occupancy curve from the columns of the new export."""
    return flow.occupancy(
        new_format(spark, folder),
        gate="name",
        direction="sap_transit_flag",
        timestamp="operator",
    )


def flow_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and running counts without a calendar."""
    return flow.sparse_flow(transactions(spark, folder))["counts"]


def flow_precounted(spark: SparkSession, folder: str) -> DataFrame:
    return flow.precounted_flow(precounted(spark, folder))


FLOWS: dict[str, Query] = {
    "flow_end_to_end": flow_end_to_end,
    "flow_imputed_table": flow_dense,
    "flow_new_format": flow_new_format,
    "flow_precounted": flow_precounted,
    "flow_sparse": flow_sparse,
}


def all_queries() -> dict[str, Query]:
    def finish(query: Query) -> Query:
        return lambda spark, folder: rounded(query(spark, folder))

    return {n: finish(q) for n, q in {**OPERATORS, **MARTS, **FLOWS}.items()}
