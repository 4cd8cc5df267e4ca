"""SQL with the result of each query, for DuckDB on the same tables."""

from __future__ import annotations

from gateflow.functions.fixed import DEFAULT_GATES

D = "transit_direction_description"
N = "transacciones_por_hora"
GATES = ", ".join(f"'{gate}'" for gate in DEFAULT_GATES)
GATE_CASES = " ".join(
    f"WHEN {number} THEN '{gate}'" for number, gate in enumerate(DEFAULT_GATES)
)
HOURS = range(24)
BANDS = ("Madrugada", "Maniana", "Tarde", "Noche")
WEEKDAYS = ("Lun", "Mar", "Mié", "Jue", "Vie", "Sáb", "Dom")


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def band(hour: str) -> str:
    return (
        f"CASE WHEN {hour} BETWEEN 0 AND 5 THEN 'Madrugada' "
        f"WHEN {hour} BETWEEN 6 AND 12 THEN 'Maniana' "
        f"WHEN {hour} BETWEEN 13 AND 18 THEN 'Tarde' "
        f"WHEN {hour} BETWEEN 19 AND 23 THEN 'Noche' END"
    )


def weekday(date: str) -> str:
    return f"CAST(isodow({date}) AS INTEGER)"


def day_type(date: str) -> str:
    return (
        f"CASE WHEN isodow({date}) BETWEEN 1 AND 5 THEN 'L-V' "
        f"WHEN isodow({date}) = 6 THEN 'Sab' WHEN isodow({date}) = 7 THEN 'Dom' END"
    )


def day_label(date: str) -> str:
    cases = " ".join(f"WHEN {n} THEN '{label}'" for n, label in enumerate(WEEKDAYS, 1))
    return f"CASE isodow({date}) {cases} END"


LABELS = (
    f"{band('hora')} AS franja_horaria, {weekday('fecha')} AS dia_sem, "
    f"{day_type('fecha')} AS tipo_dia"
)
RANK = (
    "CASE franja_horaria WHEN 'Madrugada' THEN 1 WHEN 'Maniana' THEN 2 "
    "WHEN 'Tarde' THEN 3 WHEN 'Noche' THEN 4 END"
)


def outside(x: str, low: str, high: str) -> str:
    return f"(round({x} - ({low}), 9) < 0 OR round({x} - ({high}), 9) > 0)"


def replaced(x: str) -> str:
    far = outside(x, "limite_inferior", "limite_superior")
    return f"CASE WHEN {far} THEN mu WHEN NOT {far} THEN CAST({x} AS DOUBLE) END"


def net(source: str, value: str, name: str, fill: str | None, kind: str) -> str:
    def side(way: str) -> str:
        total = f"sum({value}) FILTER (WHERE {D} = '{way}')"
        return f"coalesce({total}, {fill})" if fill is not None else total

    return (
        f"SELECT fecha, hora, CAST({side('Entry')} - {side('Exit')} AS {kind}) AS {name} "
        f"FROM {source} WHERE {D} IN ('Entry', 'Exit') GROUP BY fecha, hora"
    )


def joined(left: str, right: str, keys: list[str]) -> str:
    matches = " AND ".join(f"l.{k} IS NOT DISTINCT FROM s.{k}" for k in keys)
    return f"{left} l LEFT JOIN {right} s ON {matches}"


GROUPS = ["tipo_dia", "franja_horaria", D]
STATS = "s.mu, s.sigma, s.limite_inferior, s.limite_superior"
_FLOORED = "CASE WHEN x < 0 THEN 0.0 ELSE x END"
_DAY = f"PARTITION BY fecha, {D} ORDER BY hora ROWS UNBOUNDED PRECEDING"

# Each step builds on the ones before it.
STEPS = {
    "tx": f"""
        SELECT event_id,
               CASE user_id % 12 {GATE_CASES} ELSE 'TK99RT99' END AS tema_key,
               ts AS transaction_date,
               CASE WHEN event_type IN ('view', 'signup') THEN 'Entry'
                    WHEN event_type IN ('purchase', 'error') THEN 'Exit'
                    ELSE 'Denied' END AS {D},
               event_type AS transit_status_description,
               CAST(user_id AS VARCHAR) AS card_number
        FROM events""",
    "counts": f"""
        SELECT CAST(transaction_date AS DATE) AS fecha, {D},
               CAST(hour(transaction_date) AS INTEGER) AS hora,
               count(*) AS transacciones_por_hora
        FROM tx WHERE tema_key IN ({GATES}) GROUP BY ALL""",
    "grid": f"""
        SELECT fecha, {D}, CAST(h AS INTEGER) AS hora
        FROM (SELECT DISTINCT fecha FROM counts), (SELECT DISTINCT {D} FROM counts),
             range(24) hours(h)""",
    "filled": f"""
        SELECT l.fecha, l.{D}, l.hora,
               coalesce(s.transacciones_por_hora, 0) AS transacciones_por_hora
        FROM {joined('grid', 'counts', ['fecha', D, 'hora'])}""",
    "dense": f"""
        SELECT *, CAST(sum(transacciones_por_hora) OVER ({_DAY}) AS BIGINT)
                  AS conteo_acumulado, {LABELS}
        FROM filled""",
    "stats": f"""
        SELECT *, mu - 2 * sigma AS limite_inferior, mu + 2 * sigma AS limite_superior
        FROM (SELECT {', '.join(GROUPS)}, avg(transacciones_por_hora) AS mu,
                     stddev_samp(transacciones_por_hora) AS sigma
              FROM dense GROUP BY ALL)""",
    "attached": f"SELECT l.*, {STATS} FROM {joined('dense', 'stats', GROUPS)}",
    "corrected": f"""
        SELECT *, {replaced('transacciones_por_hora')} AS conteo_corregido
        FROM attached""",
    "floored": f"""
        SELECT * EXCLUDE (x), {_FLOORED} AS transacciones_imputadas
        FROM (SELECT *, {replaced('transacciones_por_hora')} AS x FROM attached)""",
    "imputed": f"""
        SELECT *, sum(transacciones_imputadas) OVER ({_DAY})
                  AS conteo_acumulado_imputado
        FROM floored""",
    "net": f"""
        SELECT *, {LABELS} FROM ({net(
            "(SELECT * FROM imputed WHERE fecha IS NOT NULL)",
            "conteo_acumulado_imputado", "flujo_neto_ajustado", "0", "DOUBLE")})""",
    "raw_net": f"""
        SELECT *, {LABELS} FROM ({net(
            "(SELECT * FROM dense WHERE fecha IS NOT NULL)",
            "conteo_acumulado", "diferencia", "0", "BIGINT")})""",
    "hourly_net": f"""
        SELECT *, {LABELS}, CAST(day(fecha) AS INTEGER) AS dia_del_mes
        FROM ({net("imputed", "transacciones_imputadas", "diferencia_neta", "0",
                   "DOUBLE")})""",
    "people": f"""
        SELECT CAST(transaction_date AS DATE) AS fecha,
               CAST(hour(transaction_date) AS INTEGER) AS hora,
               CAST(sum(CASE WHEN {D} = 'Entry' THEN 1 ELSE 0 END) AS BIGINT)
                   AS entradas,
               CAST(sum(CASE WHEN {D} = 'Exit' THEN 1 ELSE 0 END) AS BIGINT) AS salidas
        FROM tx GROUP BY ALL""",
    "hour_stats": """
        SELECT hora, avg(entradas - salidas) AS media,
               stddev_samp(entradas - salidas) AS desviacion
        FROM people GROUP BY hora""",
    "flagged": f"""
        SELECT l.*, entradas - salidas AS personas_por_hora, media, desviacion,
               round(abs(entradas - salidas - media) - 2 * desviacion, 9) > 0
                   AS se_sale_de_media
        FROM {joined('people', 'hour_stats', ['hora'])}""",
    "loaded": f"""
        SELECT 'file-' || (event_id % 40) || '.xlsx' AS source_path,
               event_id AS row_idx, tema_key,
               CASE WHEN event_id % 50 <> 7 THEN transaction_date END
                   AS transaction_date,
               {D}, transit_status_description, card_number,
               CAST(NULL AS VARCHAR) AS identifier, CAST(NULL AS VARCHAR) AS parameter_1
        FROM tx""",
    "loaded_counts": f"""
        SELECT CAST(transaction_date AS DATE) AS fecha, {D},
               CAST(hour(transaction_date) AS INTEGER) AS hora, count(*) AS {N}
        FROM loaded WHERE tema_key IN ({GATES}) GROUP BY ALL""",
    "holed": f"""
        SELECT *, CASE WHEN hora % 7 <> 3 OR {D} <> 'Entry' THEN {N} END AS valor
        FROM dense WHERE {D} <> 'Exit' OR day(fecha) % 5 <> 0""",
    "own": f"""
        SELECT * REPLACE (CASE WHEN hora = 0 THEN {D} || '-' || fecha ELSE {D} END
                          AS {D}) FROM dense""",
    "own_stats": f"""
        SELECT {', '.join(GROUPS)}, avg({N}) AS mu, stddev_samp({N}) AS sigma
        FROM own GROUP BY ALL""",
}


def sql(query: str) -> str:
    steps = ",\n".join(f"{name} AS ({body})" for name, body in STEPS.items())
    return f"WITH {steps}\n{query}"


def wide(
    source: str, ids: str, key: str, values, value: str, agg: str, fill: str = "",
    kind: str = "BIGINT", where: str = "TRUE",
) -> str:
    def cell(wanted) -> str:
        literal = f"'{wanted}'" if isinstance(wanted, str) else wanted
        found = f"{agg}({value}) FILTER (WHERE {key} = {literal})"
        found = f"coalesce({found}, {fill})" if fill else found
        if kind == "DOUBLE":
            found = f"round({found}, 6) + 0.0"
        return f'CAST({found} AS {kind}) AS "{wanted}"'

    cells = ", ".join(map(cell, values))
    return f"SELECT {ids}, {cells} FROM {source} WHERE {where} GROUP BY {ids}"


def box(source: str, groups: str, value: str, local: bool = False) -> str:
    """Boxplot statistics by quantiles joined back to the rows."""
    keys = groups.split(", ")
    points = (
        f", {r('any_value(media)', 'media_local')}, {r('any_value(p10)', 'p10_local')}, "
        f"{r('any_value(p90)', 'p90_local')}"
        if local
        else ""
    )
    low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    far = outside(value, low, high)
    listed = ", ".join(f"l.{key}" for key in keys)
    return f"""
        SELECT {groups}, count(*) AS n, {r('any_value(q1)', 'q1')},
               {r('any_value(q2)', 'mediana')}, {r('any_value(q3)', 'q3')},
               {r('least(min(v) FILTER (WHERE NOT far), any_value(q1))',
                  'bigote_inferior')},
               {r('greatest(max(v) FILTER (WHERE NOT far), any_value(q3))',
                  'bigote_superior')},
               count(*) FILTER (WHERE far) AS n_atipicos{points}
        FROM (SELECT {listed}, CAST({value} AS DOUBLE) AS v, {far} AS far, q1, q2, q3,
                     media, p10, p90
              FROM {joined(f'({source})', f'''(
                  SELECT {groups}, quantile_cont({value}, 0.25) AS q1,
                         quantile_cont({value}, 0.5) AS q2,
                         quantile_cont({value}, 0.75) AS q3,
                         quantile_cont({value}, 0.1) AS p10,
                         quantile_cont({value}, 0.9) AS p90, avg({value}) AS media
                  FROM ({source}) GROUP BY {groups})''', keys)})
        GROUP BY {groups}"""


def outliers(source: str, groups: str, value: str) -> str:
    keys = groups.split(", ")
    listed = ", ".join(f"l.{key}" for key in keys)
    far = outside(value, "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)")
    return f"""
        SELECT {listed}, CAST({value} AS DOUBLE) AS valor, count(*) AS veces
        FROM {joined(source, f'''(
            SELECT {groups}, quantile_cont({value}, 0.25) AS q1,
                   quantile_cont({value}, 0.75) AS q3
            FROM {source} GROUP BY {groups})''', keys)}
        WHERE {far} GROUP BY ALL"""


def by_band(source: str, ids: str, value: str, agg: str) -> str:
    return wide(
        source, ids, "franja_horaria", BANDS, value, agg, kind="DOUBLE",
        where="tipo_dia IS NOT NULL",
    )


G = ", ".join(GROUPS)
WEEK = f"{day_label('fecha')} AS dia_ordenado, {weekday('fecha')} AS dia_orden"
WEEK_GROUPS = "dia_ordenado, dia_orden"
BAND_GROUPS = "franja_horaria, franja_orden"
LV_DENSE = f"SELECT *, {WEEK}, {RANK} AS franja_orden FROM dense WHERE tipo_dia = 'L-V'"
LV_IMPUTED = LV_DENSE.replace("FROM dense", "FROM imputed")
LIMITS = ", ".join(
    r(name, name) for name in ("mu", "sigma", "limite_inferior", "limite_superior")
)


def weekly(source: str) -> str:
    return f"SELECT *, {WEEK} FROM {source}"


def mean_sd(source: str, value: str) -> str:
    return f"""
        SELECT {G}, {r(f'avg({value})', 'conteo_promedio')},
               {r(f'stddev_samp({value})', 'conteo_desv_estandar')}
        FROM {source} GROUP BY ALL"""


def _hour_differences() -> str:
    return ", ".join(f'"{h}_Entry" - "{h}_Exit" AS "{h}"' for h in HOURS)


def _sides() -> str:
    cells = ", ".join(
        f"CAST(coalesce(sum({N}) FILTER (WHERE hora = {h} AND {D} = '{way}'), 0) "
        f'AS BIGINT) AS "{h}_{way}"'
        for way in ("Entry", "Exit")
        for h in HOURS
    )
    return (
        f"SELECT fecha, {cells} FROM counts WHERE fecha IS NOT NULL "
        f"AND {D} IN ('Entry', 'Exit') GROUP BY fecha"
    )


ORACLES = {
    # Sources
    "op_records_typed": "SELECT * FROM loaded",
    "op_records_counts": "SELECT * FROM loaded_counts",
    "op_densify_missing_times": f"""
        SELECT g.fecha, g.{D}, g.hora, coalesce(c.{N}, 0) AS {N}
        FROM (SELECT * FROM (SELECT DISTINCT fecha FROM loaded_counts),
                            (SELECT DISTINCT {D} FROM loaded_counts),
                            (SELECT CAST(range AS INTEGER) AS hora FROM range(24))) g
        LEFT JOIN loaded_counts c
        ON g.fecha = c.fecha AND g.{D} = c.{D} AND g.hora = c.hora""",
    "op_clean_names": """
        SELECT c_custkey AS customer_key_n, c_name, c_nationkey AS nacion_key,
               round(c_acctbal, 6) AS percent_of_balance, c_name AS c_name_2,
               c_custkey AS x2nd_key, c_nationkey AS c_name_2_2,
               c_nationkey AS strasse_ae
        FROM customer""",
    "op_rename_third": """
        SELECT c_custkey, c_name, c_nationkey AS "operator" FROM customer""",
    "op_sentinel_cut": """
        SELECT event_id, e.user_id, event_type
        FROM events e LEFT JOIN (
            SELECT user_id, min(event_id) AS cut FROM events
            WHERE event_type = 'error' GROUP BY user_id) c ON e.user_id = c.user_id
        WHERE cut IS NULL OR event_id < cut""",
    "op_conform_types": """
        SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k,
               TRY_CAST(event_type AS DOUBLE) AS event_type, ts AS t
        FROM events""",
    "op_quarantine_split": """
        SELECT event_id,
               CASE event_type WHEN 'click' THEN props->>'$.k' ELSE event_type END
                   AS texto,
               CASE event_type WHEN 'click' THEN CAST(props->>'$.k' AS BIGINT) END
                   AS numero,
               CASE event_type WHEN 'click' THEN NULL ELSE event_type END AS load_error
        FROM events""",
    "op_union_by_name": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CAST(NULL AS DOUBLE) AS o_totalprice FROM orders
        UNION ALL
        SELECT o_orderkey, NULL, o_orderstatus, round(o_totalprice, 6) FROM orders""",
    "op_preview": f"""
        SELECT fecha, hora, {D}, {N}, conteo_acumulado FROM dense
        ORDER BY fecha, hora, {D} LIMIT 6""",
    # Filters, calendar, joins
    "op_gate_filter": f"SELECT * FROM tx WHERE tema_key IN ({GATES})",
    "op_gate_table": f"""
        SELECT CAST(transaction_date AS DATE) AS fecha, {D},
               CAST(hour(transaction_date) AS INTEGER) AS hora, count(*) AS {N}
        FROM tx WHERE tema_key IN (
            SELECT tema_key FROM tx GROUP BY tema_key
            HAVING count(*) FILTER (WHERE transit_status_description = 'error')
                 > count(*) FILTER (WHERE transit_status_description = 'signup'))
        GROUP BY ALL""",
    "op_drop_null_key": f"""
        SELECT tema_key AS puerta, {D}, count(*) AS n
        FROM tx WHERE tema_key <> 'TK99RT99' GROUP BY ALL""",
    "op_calendar_grid": "SELECT * FROM grid",
    "op_densify_hours": "SELECT * FROM filled",
    "op_densify_listed_directions": f"""
        SELECT * FROM filled WHERE {D} IN ('Entry', 'Exit')""",
    "op_attach_group_stats": f"SELECT fecha, hora, {G}, {N}, {LIMITS} FROM attached",
    "op_attach_day_attributes": """
        SELECT n.fecha, n.hora, n.diferencia, a.franja_horaria, a.dia_sem, a.tipo_dia
        FROM raw_net n LEFT JOIN (
            SELECT DISTINCT fecha, hora, franja_horaria, dia_sem, tipo_dia FROM dense) a
        ON n.fecha = a.fecha AND n.hora = a.hora""",
    "op_full_outer_net": f"SELECT fecha, {_hour_differences()} FROM ({_sides()})",
    "op_select_by_pattern": "SELECT " + ", ".join(
        f'CAST("{h}_Entry" AS DOUBLE) AS "{h}_Entry"' for h in HOURS
    ) + f" FROM ({_sides()})",
    "op_net_cumulative_wide": wide(
        "raw_net", "fecha", "hora", HOURS, "diferencia", "sum"
    ),
    # Aggregations
    "op_count_hourly": "SELECT * FROM counts",
    "op_count_hourly_new_format": f"SELECT * RENAME ({D} AS sap_transit_flag) FROM counts",
    "op_sum_in_out": "SELECT *, entradas - salidas AS personas_por_hora FROM people",
    "op_band_totals": f"""
        SELECT tipo_dia, {D}, franja_horaria,
               CAST(sum({N}) AS BIGINT) AS conteo_total_franja
        FROM dense GROUP BY ALL""",
    "op_corrected_band_sum": f"""
        SELECT fecha, {D}, franja_horaria,
               {r('sum(conteo_corregido)', 'conteo_corregido')}
        FROM corrected GROUP BY ALL""",
    "op_band_cumsum_sum": f"""
        SELECT fecha, {D}, franja_horaria,
               CAST(sum(conteo_acumulado) AS BIGINT) AS conteo_acumulado
        FROM dense GROUP BY ALL""",
    "op_band_sum_missing_values": f"""
        SELECT fecha, {D}, franja_horaria,
               CASE WHEN bool_or(valor IS NULL) THEN NULL
                    ELSE CAST(sum(valor) AS BIGINT) END AS estricta,
               CAST(coalesce(sum(valor), 0) AS BIGINT) AS presente
        FROM holed GROUP BY ALL""",
    "op_band_closing_level": f"""
        SELECT fecha, tipo_dia, {D}, franja_horaria,
               max(conteo_acumulado) AS conteo_final_franja
        FROM dense GROUP BY ALL""",
    "op_hourly_profile": f"""
        SELECT tipo_dia, {D}, hora, {r(f'avg({N})', 'conteo_promedio_por_hora')}
        FROM dense GROUP BY ALL""",
    "op_group_mean_sd": f"SELECT {G}, {r('mu', 'mu')}, {r('sigma', 'sigma')} FROM stats",
    "op_two_sigma_limits": f"SELECT {G}, {LIMITS} FROM stats",
    "op_local_percentiles": f"""
        SELECT {G}, {r(f'avg({N})', 'media_local')},
               {r(f'quantile_cont({N}, 0.1)', 'p10_local')},
               {r(f'quantile_cont({N}, 0.9)', 'p90_local')}
        FROM dense GROUP BY ALL""",
    "op_boxplot_stats": box("SELECT * FROM dense", G, N),
    "op_boxplot_outliers": outliers("dense", G, N),
    "op_date_range": """
        SELECT min(fecha) AS primera_fecha, max(fecha) AS ultima_fecha FROM counts""",
    "op_distinct_days": f"SELECT DISTINCT fecha, {day_type('fecha')} AS tipo_dia FROM counts",
    # Windows
    "op_cumulative_in_day": f"SELECT fecha, {D}, hora, {N}, conteo_acumulado FROM dense",
    "op_cumulative_imputed": f"""
        SELECT fecha, {D}, hora,
               {r('transacciones_imputadas', 'transacciones_imputadas')},
               {r('conteo_acumulado_imputado', 'conteo_acumulado_imputado')}
        FROM imputed""",
    "op_cumulative_sparse": f"""
        SELECT *, CAST(sum({N}) OVER ({_DAY}) AS BIGINT) AS conteo_acumulado
        FROM counts""",
    "op_day_carry_over": """
        SELECT fecha, hora, CAST(
                   (SELECT diferencia FROM raw_net
                    WHERE hora = 22 ORDER BY fecha LIMIT 1)
                   + sum(diferencia) OVER (PARTITION BY hora ORDER BY fecha
                                           ROWS UNBOUNDED PRECEDING)
               AS BIGINT) AS neto_arrastrado
        FROM raw_net WHERE fecha > (SELECT min(fecha) FROM raw_net)""",
    # Reshape
    "op_pivot_cumulative": wide(
        "dense", f"fecha, {D}", "hora", HOURS, "conteo_acumulado", "max",
        where="fecha IS NOT NULL",
    ),
    "op_pivot_imputed_cumulative": wide(
        "imputed", f"fecha, {D}", "hora", HOURS, "conteo_acumulado_imputado", "max",
        kind="DOUBLE", where="fecha IS NOT NULL",
    ),
    "op_pivot_missing_values": f"SELECT fecha, {D}, " + ", ".join(
        f"CASE WHEN bool_or(hora = {h}) THEN max(valor) FILTER (WHERE hora = {h}) "
        f'ELSE 0 END AS "{h}"'
        for h in HOURS
    ) + " FROM holed WHERE hora <> 5 OR day(fecha) % 2 <> 0 GROUP BY ALL",
    "op_pivot_counts": wide(
        "dense", f"fecha, {D}", "hora", HOURS, N, "max", "0", where="fecha IS NOT NULL"
    ),
    "op_pivot_sparse": wide("counts", f"fecha, {D}", "hora", HOURS, N, "max"),
    "op_pivot_bands": wide(
        "dense", f"fecha, {D}", "franja_horaria", BANDS, "conteo_acumulado", "max"
    ),
    "op_pivot_band_totals": wide(
        "dense", f"tipo_dia, {D}", "franja_horaria", BANDS, N, "sum"
    ),
    "op_pivot_corrected_bands": wide(
        "corrected", f"fecha, {D}", "franja_horaria", BANDS, "conteo_corregido", "sum",
        kind="DOUBLE",
    ),
    "op_pivot_band_levels": wide(
        "dense", f"fecha, {D}", "franja_horaria", BANDS, "conteo_acumulado", "sum"
    ),
    "op_pivot_month_day": wide(
        "(SELECT *, CAST(day(fecha) AS INTEGER) AS dia_del_mes FROM imputed)",
        f"dia_del_mes, {D}", "hora", HOURS, "transacciones_imputadas", "sum", "0",
        kind="DOUBLE",
    ),
    "op_pivot_corrected_hours": wide(
        "corrected", f"fecha, {D}", "hora", HOURS, "conteo_corregido", "sum",
        kind="DOUBLE",
    ),
    "op_unpivot_hours": "SELECT fecha, hora, diferencia FROM raw_net",
    # Labels and imputation
    "op_time_band": f"""
        SELECT {band('hour(transaction_date)')} AS franja_horaria, count(*) AS n
        FROM tx GROUP BY ALL""",
    "op_day_type": f"""
        SELECT fecha, {weekday('fecha')} AS dia_sem, {day_type('fecha')} AS tipo_dia, n
        FROM (SELECT CAST(transaction_date AS DATE) AS fecha, count(*) AS n
              FROM tx GROUP BY ALL)""",
    "op_weekday_label": f"""
        SELECT {day_label('transaction_date')} AS dia_ordenado,
               {weekday('transaction_date')} AS dia_orden, count(*) AS n
        FROM tx GROUP BY ALL""",
    "op_impute_two_sigma": f"""
        SELECT fecha, {D}, hora, {N}, conteo_acumulado, franja_horaria, dia_sem,
               tipo_dia, {LIMITS},
               {r('transacciones_imputadas', 'transacciones_imputadas')}
        FROM imputed""",
    "op_impute_one_row_groups": f"""
        SELECT l.fecha, l.{D}, l.hora, {r('mu', 'mu')}, {r('sigma', 'sigma')},
               {r(f"""CASE WHEN sigma IS NULL THEN NULL
                    WHEN {outside(N, 'mu - 2 * sigma', 'mu + 2 * sigma')}
                    THEN greatest(mu, 0) ELSE CAST({N} AS DOUBLE) END""",
                  'transacciones_imputadas')}
        FROM {joined('own', 'own_stats', GROUPS)}""",
    "op_impute_on_the_limit": f"""
        SELECT fecha, {D} || '-' || fecha || '-' || (hora // 2) AS {D}, hora,
               CASE WHEN count(*) OVER (
                        PARTITION BY fecha, {D}, hora // 2, franja_horaria) = 2
                    THEN CAST({N} AS DOUBLE) END AS transacciones_imputadas
        FROM dense""",
    "op_correct_two_sigma": f"""
        SELECT fecha, {D}, hora, {N}, {r('conteo_corregido', 'conteo_corregido')}
        FROM corrected""",
    "op_adjust_net_people": f"""
        SELECT * EXCLUDE (media, desviacion), {r('media', 'media')},
               {r('desviacion', 'desviacion')},
               {r('''CASE WHEN se_sale_de_media THEN media
                          WHEN NOT se_sale_de_media
                          THEN CAST(personas_por_hora AS DOUBLE) END''',
                  'personas_por_hora_ajustado')}
        FROM flagged""",
    "op_imputation_audit": f"""
        SELECT fecha, hora, {G}, {N}, {r('limite_inferior', 'limite_inferior')},
               {r('limite_superior', 'limite_superior')},
               {r('transacciones_imputadas', 'transacciones_imputadas')}
        FROM imputed""",
    # Net flow
    "op_net_cumulative_imputed": f"""
        SELECT fecha, hora, {r('flujo_neto_ajustado', 'flujo_neto_ajustado')},
               franja_horaria, dia_sem, tipo_dia FROM net""",
    "op_net_cumulative_raw": "SELECT * FROM raw_net",
    "op_net_hourly": f"""
        SELECT fecha, hora, {r('diferencia_neta', 'diferencia_neta')},
               franja_horaria, dia_sem, tipo_dia, dia_del_mes FROM hourly_net""",
    "op_net_hourly_raw": f"""
        SELECT *, {LABELS}, CAST(day(fecha) AS INTEGER) AS dia_del_mes
        FROM ({net('dense', N, 'diferencia_neta', '0', 'BIGINT')})""",
    "op_net_by_band": "SELECT fecha, " + ", ".join(
        f"max(conteo_acumulado) FILTER (WHERE {D} = 'Entry' AND franja_horaria = '{b}')"
        f" - max(conteo_acumulado) FILTER (WHERE {D} = 'Exit' AND franja_horaria = '{b}')"
        f' AS "{b}"'
        for b in BANDS
    ) + " FROM dense GROUP BY fecha",
    "op_net_sparse": net(
        "(SELECT * FROM counts WHERE fecha IS NOT NULL)", N, "diferencia", None, "BIGINT"
    ),
    "op_net_missing_values": f"""
        SELECT coalesce(e.fecha, x.fecha) AS fecha, coalesce(e.hora, x.hora) AS hora,
               CASE WHEN e.fecha IS NULL THEN 0 ELSE e.valor END
               - CASE WHEN x.fecha IS NULL THEN 0 ELSE x.valor END AS diferencia
        FROM (SELECT * FROM holed WHERE {D} = 'Entry') e
        FULL JOIN (SELECT * FROM holed WHERE {D} = 'Exit') x
        ON e.fecha = x.fecha AND e.hora = x.hora""",
    # Summary tables
    "mart_net_profile": f"""
        SELECT tipo_dia, hora, {r('avg(flujo_neto_ajustado)', 'flujo_neto_promedio')}
        FROM net GROUP BY ALL""",
    "mart_net_box_hour": box("SELECT * FROM net", "tipo_dia, hora", "flujo_neto_ajustado"),
    "mart_count_heatmap": f"""
        SELECT CAST(day(fecha) AS INTEGER) AS dia_del_mes, {D}, hora, {N}, tipo_dia,
               day(fecha) || '.' || {D} AS fila
        FROM dense""",
    "mart_net_heatmap": f"""
        SELECT fecha, hora, {r('diferencia_neta', 'diferencia_neta')}, tipo_dia,
               franja_horaria, dia_del_mes FROM hourly_net""",
    "mart_variability": mean_sd("imputed", "transacciones_imputadas"),
    "mart_variability_raw": mean_sd("dense", N),
    "mart_count_box_weekday": box(
        weekly("imputed"), f"{WEEK_GROUPS}, {D}", "transacciones_imputadas"
    ),
    "mart_count_box_weekday_raw": box(weekly("dense"), f"{WEEK_GROUPS}, {D}", N),
    "mart_net_box_weekday": box(
        weekly("net"), f"{WEEK_GROUPS}, tipo_dia", "flujo_neto_ajustado", True
    ),
    "mart_band_box_lv": box(
        LV_IMPUTED, f"{BAND_GROUPS}, {D}", "transacciones_imputadas"
    ),
    "mart_band_day_box_lv": box(
        LV_DENSE, f"{WEEK_GROUPS}, {BAND_GROUPS}, {D}", N, True
    ),
    "mart_pooled_band_day_lv": box(
        LV_IMPUTED, f"{WEEK_GROUPS}, {BAND_GROUPS}", "transacciones_imputadas", True
    ),
    "mart_entry_band_series": wide(
        "corrected", f"fecha, {D}", "franja_horaria", BANDS, "conteo_corregido", "sum",
        kind="DOUBLE", where=f"{D} = 'Entry'",
    ),
    "mart_entry_band_series_level": wide(
        "dense", f"fecha, {D}", "franja_horaria", BANDS, "conteo_acumulado", "sum",
        where=f"{D} = 'Entry'",
    ),
    "mart_net_mean_band": by_band("raw_net", "tipo_dia", "diferencia", "avg"),
    "mart_net_sd_band": by_band("raw_net", "tipo_dia", "diferencia", "stddev_samp"),
    "mart_count_mean_band": by_band("dense", f"tipo_dia, {D}", N, "avg"),
    "mart_count_sd_band": by_band("dense", f"tipo_dia, {D}", N, "stddev_samp"),
}
ORACLES["flow_end_to_end"] = ORACLES["op_net_cumulative_imputed"]
ORACLES["flow_new_format"] = ORACLES["op_net_cumulative_imputed"]
ORACLES["flow_sparse"] = ORACLES["op_cumulative_sparse"]
ORACLES["flow_precounted"] = f"""
    SELECT fecha, hora, entradas, salidas, personas_por_hora, personas_por_hora_ajustado
    FROM ({ORACLES["op_adjust_net_people"]})"""
ORACLES["flow_imputed_table"] = f"""
    SELECT fecha, {D}, hora, {N}, conteo_acumulado, franja_horaria, dia_sem, tipo_dia,
           {LIMITS}, {r('transacciones_imputadas', 'transacciones_imputadas')},
           {r('conteo_acumulado_imputado', 'conteo_acumulado_imputado')}
    FROM imputed"""


# Files that a second run finds as they were, new, touched only, and gone.
FILE = "event_id % 40"
SAME, NEW, TOUCHED, GONE = (f"({FILE} % {m} = {n})" for m, n in ((5, 0), (7, 3), (11, 1), (13, 6)))
EARLY = "day(transaction_date) <= 20"

INCREMENTS = {
    "op_dense_placed": "SELECT * FROM dense",
    "op_pivot_placed": ORACLES["op_pivot_cumulative"],
    "op_day_carry_over_blocks": ORACLES["op_day_carry_over"],
    "op_running_sum_blocks": """
        SELECT event_type, event_id, valor,
               CASE WHEN bool_or(valor IS NULL) OVER so_far THEN NULL
                    ELSE CAST(sum(valor) OVER so_far AS BIGINT) END AS suma
        FROM (SELECT event_type, event_id,
                     CASE WHEN event_type <> 'click' OR event_id % 500 <> 499
                          THEN user_id END AS valor FROM events)
        WINDOW so_far AS (PARTITION BY event_type ORDER BY event_id
                          ROWS UNBOUNDED PRECEDING)""",
    "op_ledger_changes": f"""
        SELECT 'file-' || f AS path, CASE
               WHEN {NEW} THEN 'new' WHEN {GONE} THEN 'removed'
               WHEN {TOUCHED} THEN 'touched'
               WHEN {SAME} OR n = early THEN 'same' ELSE 'changed' END AS status
        FROM (SELECT {FILE} AS f, any_value(event_id) AS event_id, count(*) AS n,
                     count(*) FILTER (WHERE {EARLY}) AS early
              FROM tx GROUP BY f)
        WHERE early > 0 OR {NEW} OR NOT {GONE}""",
    "op_ledger_live_rows": f"""
        SELECT event_id, 'file-' || ({FILE}) AS source_path,
               CASE WHEN {SAME} AND NOT {NEW} THEN 'a' ELSE 'b' END AS batch
        FROM tx WHERE ({NEW} OR NOT {GONE}) AND ({NEW} OR NOT {SAME} OR {EARLY})""",
    "op_counts_taken_back": f"""
        SELECT CAST(transaction_date AS DATE) AS fecha, {D},
               CAST(hour(transaction_date) AS INTEGER) AS hora, count(*) AS {N}
        FROM tx WHERE tema_key IN ({GATES})
          AND ({NEW} OR (NOT {GONE} AND (NOT {SAME} OR {EARLY})))
        GROUP BY ALL""",
    "op_merged_statistics": ORACLES["op_two_sigma_limits"],
    "op_renewed_statistics": ORACLES["op_two_sigma_limits"],
    "op_exact_percentiles": f"""
        SELECT event_type, count(value) AS n, {r('quantile_cont(value, 0.01)', 'p01')},
               {r('quantile_cont(value, 0.5)', 'mediana')},
               {r('quantile_cont(value, 0.75)', 'p75')},
               {r('quantile_cont(value, 0.999)', 'p999')}
        FROM events GROUP BY event_type""",
    "op_boxplot_large_groups": ORACLES["op_boxplot_stats"],
    "op_boxplot_distinct_values": box(
        "SELECT event_type, value FROM events", "event_type", "value", local=True
    ),
}
BOX_SETS = {
    f"mart_sets_{name}": ORACLES[f"mart_{name}"]
    for name in (
        "net_box_hour",
        "net_box_weekday",
        "count_box_weekday",
        "band_box_lv",
        "pooled_band_day_lv",
    )
}
ORACLES |= INCREMENTS | BOX_SETS


def all_oracles() -> dict[str, str]:
    return {name: sql(query) for name, query in ORACLES.items()}
