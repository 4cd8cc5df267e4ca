from datetime import date

from gateflow.functions import (
    band_rank,
    day_type,
    floor_at_zero,
    if_else,
    label_time,
    running_sum,
    strict_sum,
    time_band,
    weekday_label,
    weekday_number,
)
from gateflow.functions.fixed import WEEKDAY_LABELS


def column(df, expression):
    return [row[0] for row in df.selectExpr(expression).collect()]


def test_time_bands_cover_the_day(spark):
    hours = spark.range(24).selectExpr("CAST(id AS INT) AS hora")
    bands = ["Madrugada"] * 6 + ["Maniana"] * 7 + ["Tarde"] * 6 + ["Noche"] * 5
    assert column(hours, time_band("hora")) == bands
    ranks = column(hours.selectExpr(f"{time_band('hora')} AS f"), band_rank("f"))
    assert ranks == [1] * 6 + [2] * 7 + [3] * 6 + [4] * 5


def test_bands_are_a_parameter(spark):
    halves = [("mañana", 0, 11), ("it's late", 12, 23)]
    hours = spark.createDataFrame([(date(2024, 1, 1), 3), (None, 20)], "fecha date, hora int")
    labelled = label_time(hours, bands=halves).collect()
    assert [r.franja_horaria for r in labelled] == ["mañana", "it's late"]


def test_labels_of_missing_or_odd_values_are_missing(spark):
    odd = spark.createDataFrame([(None, None), (24, None), (-1, None)], "h int, d date")
    assert column(odd, time_band("h")) == [None] * 3
    assert column(odd, day_type("d")) == [None] * 3
    assert column(odd, weekday_label("d")) == [None] * 3


def test_week_starts_on_monday(spark):
    week = spark.createDataFrame([(date(2024, 1, n),) for n in range(1, 8)], "d date")
    assert column(week, weekday_number("d")) == [1, 2, 3, 4, 5, 6, 7]
    assert column(week, day_type("d")) == ["L-V"] * 5 + ["Sab", "Dom"]
    assert column(week, weekday_label("d")) == WEEKDAY_LABELS
    assert column(week, weekday_label("d", WEEKDAY_LABELS[:5])) == [
        *WEEKDAY_LABELS[:5],
        None,
        None,
    ]


def test_missing_condition_gives_missing(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "x double")
    assert column(df, if_else("x > 0", "'up'", "'down'")) == ["up", "down", None]
    assert column(df, floor_at_zero("x")) == [1.0, 0.0, None]


def test_sums_spread_missing_values(spark):
    rows = [("a", 1, 1), ("a", 2, None), ("a", 3, 5), ("b", 1, 2), ("b", 2, 3)]
    df = spark.createDataFrame(rows, "k string, t int, x int")
    sums = df.groupBy("k").agg({"x": "sum"}).count()
    assert sums == 2
    df.createOrReplaceTempView("sums_spread")
    strict = spark.sql(
        f"SELECT k, {strict_sum('x')} AS s FROM sums_spread GROUP BY k ORDER BY k"
    )
    assert [r.s for r in strict.collect()] == [None, 5]
    running = df.selectExpr("k", "t", f"{running_sum('x', ['k'], 't')} AS s")
    assert [r.s for r in running.orderBy("k", "t").collect()] == [1, None, None, 2, 5]
