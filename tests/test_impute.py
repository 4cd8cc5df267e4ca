import statistics
from datetime import date

import pytest

from gateflow.operators.counts import COUNT, DIRECTION
from gateflow.operators.impute import (
    adjust_net_people,
    correct_two_sigma,
    impute_two_sigma,
    imputation_audit,
)

DENSE = (
    f"fecha date, {DIRECTION} string, hora int, {COUNT} bigint, "
    "franja_horaria string, tipo_dia string"
)
DAY = date(2024, 1, 1)


def dense(spark, values, day_type="L-V"):
    rows = [(DAY, "Entry", h % 24, v, "Tarde", day_type) for h, v in enumerate(values)]
    return spark.createDataFrame(rows, DENSE)


def test_outliers_become_the_mean_and_the_rest_stays(spark):
    values = [10] * 12 + [11, 9, 100]
    mu, sigma = statistics.mean(values), statistics.stdev(values)
    found = dense(spark, values).transform(impute_two_sigma).collect()
    assert len(found) == len(values)
    for row in found:
        expected = mu if abs(row[COUNT] - mu) > 2 * sigma else row[COUNT]
        assert row.transacciones_imputadas == pytest.approx(expected)
        assert row.limite_superior == pytest.approx(mu + 2 * sigma)
    assert sum(row.transacciones_imputadas != row[COUNT] for row in found) == 1


def test_value_on_the_limit_stays(spark):
    # mean 0, sample deviation 1, so that 2 lies on the upper limit
    values = [2, -2, 0, 0, 0, 0, 0, 0, 0]
    assert statistics.stdev(values) == 1
    found = dense(spark, values).transform(correct_two_sigma).collect()
    assert sorted(row.conteo_corregido for row in found) == sorted(map(float, values))


def test_imputed_values_are_not_negative(spark):
    values = [-3, -3, -3, -4]
    imputed = dense(spark, values).transform(impute_two_sigma).collect()
    assert {row.transacciones_imputadas for row in imputed} == {0.0}
    corrected = dense(spark, values).transform(correct_two_sigma).collect()
    assert sorted(row.conteo_corregido for row in corrected) == [-4, -3, -3, -3]


def test_single_row_group_has_no_limits_and_no_value(spark):
    (row,) = dense(spark, [5]).transform(impute_two_sigma).collect()
    assert (row.mu, row.sigma, row.transacciones_imputadas) == (5.0, None, None)


def test_missing_group_key_matches_itself(spark):
    found = dense(spark, [1, 2, 3], None).transform(impute_two_sigma).collect()
    assert [row.mu for row in found] == [2.0] * 3


def test_audit_shows_both_values(spark):
    audit = dense(spark, [1, 2, 3]).transform(impute_two_sigma)
    assert imputation_audit(audit).columns[-4:] == [
        COUNT,
        "limite_inferior",
        "limite_superior",
        "transacciones_imputadas",
    ]


def test_net_people_far_from_their_hour_are_flagged(spark):
    values = [1] * 10 + [50]
    rows = [(date(2024, 1, n + 1), 8, v) for n, v in enumerate(values)]
    rows.append((date(2024, 1, 1), 9, 7))
    df = spark.createDataFrame(rows, "fecha date, hora int, personas_por_hora bigint")
    found = {(r.hora, r.personas_por_hora): r for r in adjust_net_people(df).collect()}
    assert found[8, 50].se_sale_de_media is True
    assert found[8, 50].personas_por_hora_ajustado == pytest.approx(statistics.mean(values))
    assert found[8, 1].personas_por_hora_ajustado == 1
    lone = found[9, 7]
    assert (lone.se_sale_de_media, lone.personas_por_hora_ajustado) == (None, None)
