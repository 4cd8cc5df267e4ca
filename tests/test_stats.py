import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gateflow.operators import stats

groups = st.lists(
    st.tuples(st.sampled_from(["a", "b", None]), st.integers(-40, 40)), min_size=1
)


def expected_box(values):
    q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in values if low <= v <= high]
    return {
        "n": len(values),
        "q1": q1,
        "mediana": median,
        "q3": q3,
        "bigote_inferior": min([*inside, q1]),
        "bigote_superior": max([*inside, q3]),
        "n_atipicos": len(values) - len(inside),
        "media_local": np.mean(values),
        "p10_local": np.quantile(values, 0.1),
        "p90_local": np.quantile(values, 0.9),
    }


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(groups)
def test_boxes_against_numpy(spark, rows):
    df = spark.createDataFrame([*rows, ("a", None)], "g string, x int")
    found = {
        r.g: r.asDict()
        for r in stats.boxplot_stats(df, ["g"], "x", local_points=True).collect()
    }
    by_group: dict = {}
    for group, value in rows:
        by_group.setdefault(group, []).append(value)
    assert set(found) == set(by_group)
    for group, values in by_group.items():
        expected = expected_box(values)
        assert {k: found[group][k] for k in expected} == pytest.approx(expected)


def test_outliers_are_listed_with_their_frequency(spark):
    values = [1, 2, 2, 3, 3, 3, 4, 4, 5, 90, 90, -70]
    df = spark.createDataFrame([("a", v) for v in values], "g string, x int")
    found = stats.boxplot_outliers(df, ["g"], "x").collect()
    assert sorted((r.valor, r.veces) for r in found) == [(-70.0, 1), (90.0, 2)]


def test_percentiles_are_linear(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 2, 3, 4]], "g string, x int")
    (row,) = stats.local_percentiles(df, ["g"], "x").collect()
    assert (row.media_local, row.p10_local, row.p90_local) == pytest.approx((2.5, 1.3, 3.7))


def test_boxes_of_sets_keep_missing_keys_apart(spark):
    rows = [(a, b, float(i * i % 37)) for i, (a, b) in enumerate([("x", 1), ("x", None), (None, 1), ("y", 2)] * 30)]
    frame = spark.createDataFrame([*rows, ("x", 1, None)], "a string, b int, v double")
    sets = {"both": ["a", "b"], "left": ["a"], "right": ["b"], "turned": ["b", "a"]}
    tables = stats.boxes_of_sets(frame, "v", sets)
    for name, groups in sets.items():
        plain = stats.boxplot_stats(frame, groups, "v", local_points=True)
        assert tables[name].columns == plain.columns
        assert sorted(map(tuple, tables[name].collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
