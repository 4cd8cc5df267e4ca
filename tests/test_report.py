from datetime import datetime, timedelta

from gateflow.__main__ import main
from gateflow.catalog.adapter import new_format, transactions
from gateflow.plans.flow import flow_tables
from gateflow.plans.report import report
from gateflow.sources.bundle import read_bundle
from workbook_files import workbook_bytes

FOLDER = "/root/testdata/sf0.001"


def test_report_is_the_same_for_both_formats(spark):
    old = report(flow_tables(transactions(spark, FOLDER)))
    direction = "sap_transit_flag"
    new = report(
        flow_tables(
            new_format(spark, FOLDER),
            gate="name",
            direction=direction,
            timestamp="operator",
        ),
        direction,
    )
    for name in ("net_profile", "count_mean_band", "band_day_box", "month_day"):
        rows = [
            sorted(map(repr, map(tuple, df.collect()))) for df in (old[name], new[name])
        ]
        assert rows[0] == rows[1] and rows[0]


def test_bands_are_used_throughout(spark):
    halves = [("Mañana", 0, 11), ("Tarde", 12, 23)]
    tables = flow_tables(transactions(spark, FOLDER), bands=halves)
    results = report(tables, bands=halves)
    assert results["net_mean_band"].columns == ["tipo_dia", "Mañana", "Tarde"]
    for name in ("net_by_band", "count_mean_band", "entry_series"):
        assert results[name].dropna().count() == results[name].count() > 0
    bands = {r.franja_horaria for r in results["net_heatmap"].collect()}
    assert bands == {"Mañana", "Tarde"}


def test_command_writes_every_table(spark, tmp_path, capsys):
    header = ["Tema Key", "Transaction Date", "Transit Direction Description"]
    start = datetime(2024, 5, 1, 7)
    rows = [
        ["TK54RT54", start + timedelta(hours=n), "Exit" if n % 3 else "Entry"]
        for n in range(96)
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(workbook_bytes([["r"], header, *rows]))
    (tmp_path / "in" / "b.xlsx").write_bytes(b"PK no")
    out = tmp_path / "out"
    bands = ["--bands", "Mañana:0:11", "Tarde:12:23"]
    main([str(tmp_path / "in"), str(out), *bands])
    assert "dates 2024-05-01 to 2024-05-05, 1 files refused" in capsys.readouterr().out
    written = {p.name for p in out.iterdir()}
    assert {"loaded", "imputed", "net", "net_box_weekday", "entry_series"} <= written
    assert {"imputation_audit", "closing_levels", "day_carry_over"} <= written
    assert spark.read.parquet(str(out / "net_by_band")).columns[1:] == ["Mañana", "Tarde"]
    for name in written - {"loaded", "quarantine", "untimed"}:
        assert spark.read.parquet(str(out / name)).count() > 0, name


def test_command_refreshes_what_it_wrote(spark, tmp_path, capsys):
    header = ["Tema Key", "Transaction Date", "Transit Direction Description"]
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for name, day in (("a", 1), ("b", 8)):
        start = datetime(2024, 5, day, 7)
        rows = [
            ["TK54RT54", start + timedelta(hours=n), "Exit" if n % 3 else "Entry"]
            for n in range(40)
        ]
        (folder / f"{name}.xlsx").write_bytes(workbook_bytes([["r"], header, *rows]))
        main([str(folder), out, "--refresh"])
    said = capsys.readouterr().out.splitlines()
    assert said[0].startswith("1 new, dates 2024-05-01")
    assert said[1] == "1 new, 1 same, dates 2024-05-01 to 2024-05-09, 0 files refused"
    back = read_bundle(spark, out, ["counts", "net_box_weekday", "files"])
    assert back["counts"].agg({"transacciones_por_hora": "sum"}).first()[0] == 80
    assert back["files"].count() == 2 and back["net_box_weekday"].count() > 0
