"""Second runs over folders that grew, changed or shrank."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gateflow.operators.counts import COUNT
from gateflow.plans.flow import flow_from_folder
from gateflow.plans.refresh import flow_from_refreshed_folder, refreshed_counts
from gateflow.sources import ledger
from gateflow.sources.ledger import file_changes, refresh_workbooks, refreshed_rows
from gateflow.sources.workbooks import PRECOUNTED_EXPORT, ingest_workbooks
from workbook_files import workbook_bytes

HEADER = [
    "Tema Key",
    "Transaction Date",
    "Transit Direction Description",
    "Transit Status Description",
    "Card Number",
    "Identifier",
    "Parameter 1",
]
START = datetime(2024, 3, 4)


def export(seed, n=30):
    rows = [["Report"], HEADER]
    for i in range(n):
        moment = START + timedelta(hours=(seed * 7 + i * 5) % 72)
        gate = ("TK54RT54", "TK55RT55", "TK00RT00")[(seed + i) % 3]
        way = ("Entry", "Exit", "Denied")[i % 3]
        rows.append([gate, moment if i % 11 else "n/a", way, "OK", i, None, None])
    return workbook_bytes(rows)


@pytest.fixture
def folder(tmp_path):
    exports = tmp_path / "exports"
    (exports / "deep").mkdir(parents=True)
    for n, name in enumerate(["a.xlsx", "b.xlsx", "deep/c {1}[x].xlsx", "d.xlsx"]):
        (exports / name).write_bytes(export(n))
    (exports / "broken.xlsx").write_bytes(export(9)[:200])
    (exports / "old.xls").write_bytes(b"binary")
    return exports


def later(path, seconds=60):
    """Another time, as a copy would have."""
    when = path.stat().st_mtime + seconds
    os.utime(path, (when, when))


def decoded(spark, refreshed):
    if refreshed.batch is None:
        return set()
    rows = spark.read.parquet(f"{refreshed.table}/rows/batch={refreshed.batch}")
    return {r[0].rsplit("/", 1)[1] for r in rows.select("source_path").distinct().collect()}


def statuses(changes):
    return {r.path.rsplit("/", 1)[1]: r.status for r in changes.collect()}


def ordered(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_unchanged_folder_decodes_no_file(spark, folder, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    first = refresh_workbooks(spark, str(folder), table)
    assert len(decoded(spark, first)) == 6 and set(statuses(first.changes()).values()) == {"new"}
    read = []
    monkeypatch.setattr(ledger, "decode_workbooks", lambda *a: read.append(a))
    monkeypatch.setattr(ledger, "_contents", lambda *a: read.append(a))
    again = refresh_workbooks(spark, str(folder), table)
    assert again.batch is None and again.version == first.version and not read
    assert set(statuses(again.changes()).values()) == {"same"}
    assert ordered(refreshed_rows(spark, again, str(folder))) == ordered(
        ingest_workbooks(spark, str(folder))
    )


def test_changes_replace_their_own_rows_alone(spark, folder, tmp_path):
    table = str(tmp_path / "table")
    first = refresh_workbooks(spark, str(folder), table)
    (folder / "a.xlsx").write_bytes(export(50, 12))
    later(folder / "b.xlsx")
    (folder / "d.xlsx").unlink()
    (folder / "e.xlsx").write_bytes(export(60))
    (folder / "broken.xlsx").write_bytes(export(70))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "table" / "rows").rglob("*.parquet")}
    second = refresh_workbooks(spark, str(folder), table)
    assert decoded(spark, second) == {"a.xlsx", "e.xlsx", "broken.xlsx"}
    assert statuses(second.changes()) == {
        "a.xlsx": "changed",
        "b.xlsx": "touched",
        "c {1}[x].xlsx": "same",
        "d.xlsx": "removed",
        "e.xlsx": "new",
        "broken.xlsx": "changed",
        "old.xls": "same",
    }
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert ordered(refreshed_rows(spark, second, str(folder))) == ordered(
        ingest_workbooks(spark, str(folder))
    )
    # A file of the same length and time is taken for the same; the touched one is known now.
    third = refresh_workbooks(spark, str(folder), table)
    assert third.batch is None and first.version < second.version == third.version


def test_a_run_that_fails_leaves_the_table(spark, folder, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    first = refresh_workbooks(spark, str(folder), table)
    rows = ordered(refreshed_rows(spark, first, str(folder)))
    (folder / "e.xlsx").write_bytes(export(60))
    (tmp_path / "table" / "ledger" / "version=2").mkdir()

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "type_records", fails)
        with pytest.raises(RuntimeError):
            refresh_workbooks(spark, str(folder), table)
    (tmp_path / "table" / "ledger" / "version=2").rmdir()
    kept = ledger.read_ledger(spark, table)
    assert ordered(kept) == ordered(first.ledger)
    assert rows == ordered(ledger.read_batches(
        spark, table, "rows", ledger.loaded_schema(ledger.OLD_EXPORT), kept).drop("batch"))
    assert decoded(spark, refresh_workbooks(spark, str(folder), table)) == {"e.xlsx"}


def test_empty_folder_stops_the_first_run_only(spark, folder, tmp_path):
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError, match="no .xls"):
        refresh_workbooks(spark, str(empty), str(tmp_path / "none"))
    table = str(tmp_path / "table")
    refresh_workbooks(spark, str(folder), table)
    for path in folder.rglob("*.xls*"):
        path.unlink()
    gone = refresh_workbooks(spark, str(folder), table)
    assert refreshed_rows(spark, gone, str(folder)).count() == 0


def test_flow_follows_the_folder(spark, folder, tmp_path):
    table = str(tmp_path / "table")

    def check():
        whole = flow_from_folder(spark, str(folder))
        kept = flow_from_refreshed_folder(spark, str(folder), table)
        assert set(whole) | {"files"} == set(kept)
        for name in ("counts", "net", "quarantine", "untimed"):
            mine, other = kept[name], whole[name]
            for column, kind in other.dtypes:
                if kind == "double":
                    mine = mine.withColumn(column, F.round(column, 9))
                    other = other.withColumn(column, F.round(column, 9))
            assert ordered(mine) == ordered(other), name
        return statuses(kept["files"])

    assert set(check().values()) == {"new"}
    (folder / "a.xlsx").write_bytes(export(51, 45))
    (folder / "d.xlsx").unlink()
    (folder / "f.xlsx").write_bytes(export(61))
    assert check()["f.xlsx"] == "new"


def test_totals_read_no_rows_of_other_files(spark, folder, tmp_path):
    table = str(tmp_path / "table")
    first = refresh_workbooks(spark, str(folder), table)
    refreshed_counts(spark, first)
    (folder / "e.xlsx").write_bytes(export(60))
    second = refresh_workbooks(spark, str(folder), table)
    old_rows = tmp_path / "table" / "rows" / f"batch={first.batch}"
    for path in old_rows.glob("*.parquet"):
        path.write_bytes(b"unreadable")
    for path in old_rows.glob(".*.crc"):
        path.unlink()
    totals, parts = refreshed_counts(spark, second)
    assert totals.agg(F.sum(COUNT)).first()[0] == parts.agg(F.sum(COUNT)).first()[0] == 30 * 5


def test_precounted_exports_follow_too(spark, tmp_path):
    exports = tmp_path / "exports"
    exports.mkdir()
    header = ["Operator", "Entradas", "Salidas"]
    header[0] = "Operator NN Date"

    def write(name, n):
        rows = [[START + timedelta(hours=i), 5 + i, i] for i in range(n)]
        (exports / name).write_bytes(workbook_bytes([header, *rows]))

    table = str(tmp_path / "table")
    write("b.xlsx", 9)
    for n in (5, 7):
        write("a.xlsx", n)
        got = flow_from_refreshed_folder(spark, str(exports), table, layout=PRECOUNTED_EXPORT)
        want = flow_from_folder(spark, str(exports), layout=PRECOUNTED_EXPORT)
        assert ordered(got["people"]) == ordered(want["people"])


def test_status_of_missing_times_and_digests(spark):
    schema = "path string, length long, modified timestamp, digest string"
    one, two = datetime(2024, 1, 1), datetime(2024, 1, 2)
    now = [("a", 1, one, None), ("b", 1, None, None), ("c", 1, two, None), ("d", 1, two, "x"), ("e", 2, one, "y")]
    old = [("a", 1, one, "q"), ("b", 1, None, "q"), ("c", 1, one, "q"), ("d", 1, one, "x"), ("f", 1, one, "z")]
    got = file_changes(spark.createDataFrame(now, schema), spark.createDataFrame(old, schema))
    assert dict(map(tuple, got.collect())) == {
        "a": "same", "b": "same", "c": "changed", "d": "touched", "e": "new", "f": "removed",
    }
