from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gateflow.functions import label_time
from gateflow.operators import netflow, reshape
from gateflow.operators.calendar import accumulate
from gateflow.operators.counts import COUNT, DIRECTION

SCHEMA = f"fecha date, {DIRECTION} string, hora int, {COUNT} bigint"
FIRST = date(2024, 1, 1)


def counts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_day_with_exits_only_counts_entries_as_zero(spark):
    df = counts(spark, [(FIRST, "Exit", 5, 4), (FIRST, "Denied", 6, 9)])
    (row,) = netflow.net_by_hour(df, COUNT, "neto").collect()
    assert (row.fecha, row.hora, row.neto) == (FIRST, 5, -4)
    (row,) = netflow.net_by_hour(df, COUNT, "neto", fill=None).collect()
    assert row.neto is None


def test_a_missing_value_is_not_an_absent_row(spark):
    rows = [(FIRST, "Entry", 8, None), (FIRST, "Exit", 8, 2), (FIRST, "Exit", 9, 3)]
    df = counts(spark, rows)
    found = {r.hora: r.neto for r in netflow.net_by_hour(df, COUNT, "neto").collect()}
    assert found == {8: None, 9: -3}
    wide = {r[DIRECTION]: r for r in reshape.pivot_month_day(df, COUNT).collect()}
    assert wide["Entry"]["8"] is None and wide["Entry"]["9"] == 0
    sides = netflow.full_outer_sides(df, COUNT).first()
    assert sides["8_Entry"] == 0 and sides["8_Exit"] == 2


def test_one_row_groups_stay_missing_down_to_the_net(spark):
    from gateflow.plans.flow import IMPUTED_LEVEL, NET, flow_tables

    rows = [("TK54RT54", f"2024-01-01 08:{n:02d}:00", "Entry" if n < 7 else "Exit") for n in range(9)]
    df = spark.createDataFrame(rows, f"tema_key string, t string, {DIRECTION} string")
    df = df.selectExpr("tema_key", "CAST(t AS TIMESTAMP_NTZ) AS transaction_date", DIRECTION)
    bands = [("a", 0, 7), ("ocho", 8, 8), ("b", 9, 23)]
    tables = flow_tables(df, bands=bands)
    net = {r.hora: r[NET] for r in tables["net"].collect()}
    assert net[7] == 0 and net[8] is None and net[9] is None
    hourly = {r.hora: r.diferencia_neta for r in tables["hourly_net"].collect()}
    assert hourly[8] is None and hourly[9] == 0
    assert IMPUTED_LEVEL in tables["imputed"].columns


def test_level_sums_skip_what_is_missing(spark):
    from gateflow.plans import marts

    df = counts(spark, [(FIRST, "Entry", 8, 1), (FIRST, "Entry", 9, None)])
    df = label_time(df)
    assert marts.band_sums(df, COUNT, "n").first().n is None
    assert marts.band_sums(df, COUNT, "n", skip_missing=True).first().n == 1


def test_missing_dates_stay_in_the_hourly_net_only(spark):
    df = counts(spark, [(None, "Entry", 5, 4), (FIRST, "Entry", 5, 1)])
    assert netflow.net_hourly(df, COUNT).count() == 2
    assert netflow.net_by_hour(df, COUNT, "neto").count() == 1


def test_sides_are_aligned_by_day(spark):
    second = FIRST + timedelta(days=1)
    df = counts(spark, [(FIRST, "Entry", 0, 2), (second, "Exit", 23, 3)])
    wide = netflow.full_outer_sides(df, COUNT)
    sides = {r.fecha: r for r in wide.collect()}
    assert sides[FIRST]["0_Entry"] == 2 and sides[FIRST]["0_Exit"] == 0
    net = {r.fecha: r for r in netflow.net_of_sides(wide).collect()}
    assert net[second]["23"] == -3 and net[second]["0"] == 0


def test_carry_over_against_the_row_by_row_sum(spark):
    days = [FIRST + timedelta(days=n) for n in range(5)]
    level = {(d, h): 7 * n + h * (-1) ** n for n, d in enumerate(days) for h in range(24)}
    rows = [(d, h, v) for (d, h), v in level.items()]
    df = spark.createDataFrame(rows, "fecha date, hora int, neto bigint")
    for seed_hour in (22, 23):
        found = {
            (r.fecha, r.hora): r.neto_arrastrado
            for r in netflow.day_carry_over(df, "neto", seed_hour=seed_hour).collect()
        }
        carried = [level[days[0], seed_hour]] * 24
        expected = {}
        for day in days[1:]:
            carried = [old + level[day, h] for h, old in enumerate(carried)]
            expected.update({(day, h): v for h, v in enumerate(carried)})
        assert found == expected


cells = st.dictionaries(
    st.tuples(st.integers(0, 3), st.sampled_from(["Entry", "Exit"]), st.integers(0, 23)),
    st.integers(0, 50),
    min_size=1,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(cells)
def test_pivot_and_unpivot_restore_the_counts(spark, seen):
    rows = [(FIRST + timedelta(days=d), way, h, n) for (d, way, h), n in seen.items()]
    wide = reshape.pivot_hours(counts(spark, rows), COUNT)
    long = reshape.unpivot_hours(wide, ["fecha", DIRECTION], COUNT)
    known = long.dropna(subset=[COUNT]).collect()
    assert sorted(tuple(r) for r in known) == sorted(rows)


def test_closing_level_and_net_by_band(spark):
    rows = [(FIRST, "Entry", h, 1) for h in range(24)]
    rows += [(FIRST, "Exit", h, 2) for h in range(24)]
    df = counts(spark, rows).transform(accumulate).transform(label_time)
    (row,) = netflow.net_by_band(df).collect()
    assert (row.Madrugada, row.Maniana, row.Tarde, row.Noche) == (-6, -13, -19, -24)
    levels = netflow.closing_level(df, ["fecha", DIRECTION]).collect()
    assert {(r[DIRECTION], r.franja_horaria): r.conteo_final_franja for r in levels}[
        "Exit", "Tarde"
    ] == 38


def test_equal_month_days_add_up(spark):
    rows = [(date(2024, 1, 3), "Entry", 4, 1), (date(2024, 2, 3), "Entry", 4, 5)]
    (row,) = reshape.pivot_month_day(counts(spark, rows), COUNT).collect()
    assert (row.dia_del_mes, row["4"], row["5"]) == (3, 6, 0)


def test_columns_by_name_pattern_and_type(spark):
    df = spark.createDataFrame([("1", "2", "x")], "a_Entry string, b_Entry string, a_Exit string")
    assert reshape.by_name_pattern(df, suffix="_Entry").columns == ["a_Entry", "b_Entry"]
    assert reshape.by_name_pattern(df, "a_").columns == ["a_Entry", "a_Exit"]
    numeric = reshape.as_numeric(df.select("a_Entry"), ["a_Entry"])
    assert numeric.dtypes == [("a_Entry", "double")]
