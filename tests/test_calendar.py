from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gateflow.operators import calendar
from gateflow.operators.calendar import calendar_grid, dense_table, densify_hours
from gateflow.operators.counts import (
    COUNT,
    DIRECTION,
    count_hourly,
    date_range,
    keep_gates,
    require_rows,
    sum_in_out,
)
from gateflow.operators.reshape import pivot_hours
from gateflow.session import release

SCHEMA = f"tema_key string, transaction_date timestamp_ntz, {DIRECTION} string"
START = datetime(2024, 2, 28)


def transactions(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_per_date_direction_and_hour(spark):
    rows = [("g", START, "Entry")] * 3 + [("g", START + timedelta(hours=1), "Exit")]
    counts = count_hourly(transactions(spark, rows)).collect()
    assert sorted((r.fecha, r[DIRECTION], r.hora, r[COUNT]) for r in counts) == [
        (START.date(), "Entry", 0, 3),
        (START.date(), "Exit", 1, 1),
    ]


def test_gate_filter_takes_a_list_or_a_table(spark):
    df = transactions(spark, [("a", START, "Entry"), ("b", START, "Exit"), (None, START, "x")])
    assert [r.tema_key for r in keep_gates(df, ["a"]).collect()] == ["a"]
    wanted = spark.createDataFrame([("b",), ("b",)], "gate string")
    assert [r.tema_key for r in keep_gates(df, wanted).collect()] == ["b"]


def test_missing_timestamp_spawns_an_empty_day_per_direction(spark):
    rows = [("g", None, "Entry"), ("g", START, "Exit")]
    dense = dense_table(count_hourly(transactions(spark, rows))).collect()
    assert len(dense) == 2 * 2 * 24
    nowhere = [r for r in dense if r.fecha is None]
    assert len(nowhere) == 48
    assert {r[COUNT] for r in nowhere} == {0}
    assert {r.tipo_dia for r in nowhere} == {None}


def test_listed_directions_replace_those_found(spark):
    rows = [("g", START, "Entry"), ("g", START, "Denied")]
    dense = densify_hours(
        count_hourly(transactions(spark, rows)), directions=["Entry", "Exit"]
    )
    totals = Counter()
    for row in dense.collect():
        totals[row[DIRECTION]] += row[COUNT]
    assert totals == {"Entry": 1, "Exit": 0}
    assert dense.count() == 48


def test_grid_pairs_every_date_with_every_direction(spark):
    days = [START + timedelta(days=n) for n in range(40)]
    rows = [("g", day, f"way {n % 3}") for n, day in enumerate(days)]
    grid = calendar_grid(count_hourly(transactions(spark, rows))).collect()
    assert len(grid) == len(set(grid)) == 40 * 3 * 24


moments = st.integers(0, 4 * 24 * 60).map(lambda m: START + timedelta(minutes=m))
events = st.lists(st.tuples(moments, st.sampled_from(["Entry", "Exit", "Denied"])), min_size=1)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(events)
def test_dense_table_against_plain_counting(spark, seen):
    dense = dense_table(
        count_hourly(transactions(spark, [("g", moment, way) for moment, way in seen]))
    ).collect()
    days = {moment.date() for moment, _ in seen}
    ways = {way for _, way in seen}
    assert len(dense) == len(days) * len(ways) * 24
    counted = Counter((m.date(), w, m.hour) for m, w in seen)
    level: dict = defaultdict(int)
    for row in sorted(dense, key=lambda r: r.hora):
        key = (row.fecha, row[DIRECTION])
        level[key] += counted[(*key, row.hora)]
        assert row[COUNT] == counted[(*key, row.hora)]
        assert row.conteo_acumulado == level[key]


def test_precounted_sums_skip_missing_values(spark):
    rows = [(START, 3, None), (START, None, None), (START + timedelta(hours=2), 1, 4)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, entradas bigint, salidas bigint")
    found = sorted(tuple(r) for r in sum_in_out(df).collect())
    assert found == [(START.date(), 0, 3, 0, 3), (START.date(), 2, 1, 4, -3)]


def test_date_range_and_guard(spark):
    df = count_hourly(transactions(spark, [("g", START, "Entry")]))
    assert date_range(df).collect() == [(date(2024, 2, 28), date(2024, 2, 28))]
    assert require_rows(df, "nothing") is df
    try:
        require_rows(df.where("false"), "nothing left")
    except ValueError as error:
        assert str(error) == "nothing left"
    else:
        raise AssertionError("an empty frame passed")


def test_placed_counts_need_no_shuffle(spark):
    rows = [
        (date(2024, 1, n), way, hour, n + hour)
        for n, way, hour in ((1, "Entry", 3), (1, "Entry", 7), (1, None, 0), (2, "Exit", 23))
    ]
    rows += [(None, "Exit", 5, 2), (date(2024, 1, 2), "Exit", None, 9)]
    counts = spark.createDataFrame(
        rows, "fecha date, transit_direction_description string, hora int, transacciones_por_hora long"
    )
    placed = calendar.place_counts(counts, buckets=3)
    dense = calendar.dense_table_of_placed(placed)
    want = calendar.dense_table(counts)
    assert dense.columns == want.columns
    assert sorted(map(tuple, dense.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    for table in (dense, pivot_hours(dense, "conteo_acumulado")):
        table.collect()
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    release(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("placed_")]
