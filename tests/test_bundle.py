"""Bundles renewed by date, and counters of one job."""

from datetime import date

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gateflow.sources import bundle as bundles
from gateflow.sources.bundle import bundle_versions, read_bundle, renew_bundle
from gateflow.sources.tallies import tallied
from gateflow.sources.workbooks import OLD_EXPORT, PRECOUNTED_EXPORT

DAYS = [date(2024, 1, n) for n in (1, 2, 3)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "fecha date, hora int, n long")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def days(n, *which):
    return [(day, hora, n) for day in which for hora in (0, 1)]


@pytest.fixture
def first(spark, tmp_path):
    folder = str(tmp_path / "out")
    tables = {
        "counts": frame(spark, days(1, *DAYS, None)),
        "profile": spark.createDataFrame([("L-V", 1.5)], "tipo_dia string, media double"),
    }
    assert renew_bundle(spark, tables, folder) == 1
    return folder


def files_below(folder, name):
    import pathlib

    return {p: p.stat().st_mtime_ns for p in pathlib.Path(folder, name).rglob("*.parquet")}


def test_renewing_a_day_leaves_the_others(spark, first):
    before = files_below(first, "counts")
    renewed = frame(spark, days(7, DAYS[1], DAYS[2]))
    assert renew_bundle(spark, {"counts": renewed}, first, [DAYS[1]]) == 2
    after = files_below(first, "counts")
    assert before.items() <= after.items() and len(after) == len(before) + 1
    back = read_bundle(spark, first, ["counts", "profile"])
    assert rows_of(back["counts"]) == sorted(days(1, DAYS[0], DAYS[2], None) + days(7, DAYS[1]), key=repr)
    assert rows_of(back["profile"]) == [("L-V", 1.5)]
    assert back["counts"].columns == ["fecha", "hora", "n"]
    assert rows_of(read_bundle(spark, first, ["counts"], 1)["counts"]) == sorted(days(1, *DAYS, None), key=repr)


def test_days_that_lost_their_rows_are_gone(spark, first):
    renew_bundle(spark, {"counts": frame(spark, [])}, first, [DAYS[0], None])
    assert rows_of(read_bundle(spark, first, ["counts"])["counts"]) == days(1, DAYS[1], DAYS[2])
    renew_bundle(spark, {"counts": frame(spark, [])}, first)
    back = read_bundle(spark, first, ["counts"])["counts"]
    assert back.count() == 0 and back.columns == ["fecha", "hora", "n"]


def test_half_a_bundle_is_not_seen(spark, first, monkeypatch):
    def fails(df, path, wanted):
        raise RuntimeError("lost")

    tables = {
        "profile": spark.createDataFrame([("Sab", 9.0)], "tipo_dia string, media double"),
        "counts": frame(spark, days(5, *DAYS)),
    }
    with monkeypatch.context() as patch:
        patch.setattr(bundles, "_write_days", fails)
        with pytest.raises(RuntimeError):
            renew_bundle(spark, tables, first)
    assert bundle_versions(spark, first) == [1]
    back = read_bundle(spark, first, ["profile", "counts"])
    assert rows_of(back["profile"]) == [("L-V", 1.5)] and back["counts"].count() == 8
    assert renew_bundle(spark, tables, first) == 2
    back = read_bundle(spark, first, ["profile", "counts"])
    assert rows_of(back["profile"]) == [("Sab", 9.0)]
    assert rows_of(back["counts"]) == days(5, *DAYS)


def test_unknown_tables_and_versions(spark, first):
    with pytest.raises(ValueError, match="no table"):
        read_bundle(spark, first, ["absent"])
    with pytest.raises(ValueError, match="not complete"):
        read_bundle(spark, first, ["counts"], 5)


def loaded(spark):
    rows = [("f", "TK54RT54", "2024-01-02 10:00:00", None)] * 5
    rows += [("f", "TK00RT00", "2024-03-02 10:00:00", None)] * 2
    rows += [("f", "TK54RT54", None, None), ("g", None, None, "broken")]
    text = "source_path string, tema_key string, transaction_date string, load_error string"
    frame = spark.createDataFrame(rows, text)
    return frame.withColumn("transaction_date", F.col("transaction_date").cast("timestamp_ntz"))


def test_one_job_loads_and_counts(spark, tmp_path):
    tally = Observation()
    rows = tallied(loaded(spark), OLD_EXPORT, ["TK54RT54"], tally)
    spark.sparkContext.setJobGroup("tally", "load and counters")
    rows.write.parquet(str(tmp_path / "rows"))
    got = tally.get
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("tally")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    day = date(2024, 1, 2)
    assert got == {"rows": 8, "refused": 1, "untimed": 1, "kept": 5, "first": day, "last": day}


def test_counters_without_gates_and_rows(spark):
    for gates, kept in ((None, 7), (["other"], 0)):
        tally = Observation()
        tallied(loaded(spark), OLD_EXPORT, gates, tally).collect()
        assert tally.get["kept"] == kept
    tally = Observation()
    none = spark.createDataFrame([], "ts timestamp_ntz, load_error string")
    tallied(none, PRECOUNTED_EXPORT, None, tally).collect()
    assert tally.get["rows"] == 0 and tally.get["first"] is None
