import io
import pathlib
import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from gateflow.operators.counts import COUNT
from gateflow.plans.flow import flow_from_folder
from gateflow.sources import conform, workbooks
from gateflow.sources.bundle import read_bundle, write_bundle
from gateflow.sources.names import clean_names, number_headers
from gateflow.sources.xlsx import read_rows
from workbook_files import workbook_bytes

QUOTES = {'"': "&quot;"}
NOON = datetime(2024, 3, 5, 12, 30, 15, 250_000)
OLD_HEADER = [
    "Tema Key",
    "Transaction Date",
    "Transit Direction Description",
    "Transit Status Description",
    "Card Number",
    "Identifier",
    "Parameter 1",
]


def old_rows(gate="TK54RT54", way="Entry"):
    return [["Report"], OLD_HEADER, [gate, NOON, way, "OK", 1234567, None, "p"]]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "2024" / "march").mkdir(parents=True)
    files = {
        "good.xlsx": workbook_bytes(old_rows()),
        "2024/march/deep.xlsx": workbook_bytes(old_rows("TK55RT55", "Exit")),
        "other_gate.xlsx": workbook_bytes(old_rows("TK00RT00")),
        "broken.xlsx": workbook_bytes(old_rows())[:300],
        "legacy.xls": b"\xd0\xcf\x11\xe0 old binary format",
        "SHOUTED.XLSX": workbook_bytes(old_rows("TK56RT56")),
        "notes.txt": b"not a workbook",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def base(path):
    return pathlib.PurePosixPath(path).name


def test_names():
    assert clean_names(["Temaline Interface", "SAPTransit Flag", "cardNumber"]) == [
        "temaline_interface",
        "sap_transit_flag",
        "card_number",
    ]
    assert clean_names(["Año", "% in", "2nd", "x y", "X.Y", ""]) == [
        "ano",
        "percent_in",
        "x2nd",
        "x_y",
        "x_y_2",
        "x",
    ]
    assert clean_names(["a", "a", "a 2", "Straße", "Ærø", "a", "a"]) == [
        "a",
        "a_2",
        "a_2_2",
        "strasse",
        "aero",
        "a_3",
        "a_4",
    ]
    assert number_headers(["a", None, "b", "a"]) == ["a...1", "...2", "b", "a...4"]


def test_cells_of_all_kinds():
    rows = [["text & <more>", 3, 2.5, True, None, NOON], [None], ["last"]]
    assert list(read_rows(workbook_bytes(rows))) == [
        (0, ["text & <more>", "3", "2.5", "TRUE", None, "2024-03-05 12:30:15.250000"]),
        (2, ["last"]),
    ]


def test_inline_strings_hints_errors_and_early_dates():
    sheet = (
        '<x:worksheet xmlns:x="m"><x:sheetData><x:row>'
        '<x:c t="inlineStr"><x:is><x:r><x:t>two </x:t></x:r><x:r><x:t>runs</x:t></x:r>'
        "<x:rPh><x:t>hint</x:t></x:rPh></x:is></x:c>"
        '<x:c t="e"><x:v>#DIV/0!</x:v></x:c><x:c t="str"><x:v> 12 </x:v></x:c>'
        '<x:c s="1"><x:v>1</x:v></x:c><x:c s="1"><x:v>61</x:v></x:c>'
        "</x:row></x:sheetData></x:worksheet>"
    )
    content = rewritten(
        workbook_bytes([["x"]]), {"xl/worksheets/sheet1.xml": lambda _: sheet}
    )
    assert list(read_rows(content)) == [
        (0, ["two runs", None, "12", "1900-01-01 00:00:00", "1900-03-01 00:00:00"])
    ]


def rewritten(content, changes):
    """The workbook with some of its parts replaced."""
    with zipfile.ZipFile(io.BytesIO(content)) as source:
        parts = {n: source.read(n) for n in source.namelist()}
    for name, change in changes.items():
        parts[name] = change(parts[name].decode()).encode()
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w") as book:
        for name, part in parts.items():
            book.writestr(name, part)
    return target.getvalue()


def test_custom_date_formats_and_the_1904_calendar():
    plain = workbook_bytes([[NOON]])
    styles = {
        'yyyy\\-mm\\-dd hh:mm:ss': "2024-03-05 12:30:15.250000",
        "[h]:mm": "2024-03-05 12:30:15.250000",
        '0.00" days"': None,
        "[Red]0.0": None,
    }
    for code, text in styles.items():
        custom = f'<numFmts><numFmt numFmtId="164" formatCode="{escape(code, QUOTES)}"/></numFmts>'
        content = rewritten(
            plain,
            {
                "xl/styles.xml": lambda s: s.replace(
                    "<cellXfs>", custom + "<cellXfs>"
                ).replace('numFmtId="22"', 'numFmtId="164"')
            },
        )
        ((_, (cell,)),) = read_rows(content)
        assert cell == text or (text is None and cell.startswith("45356.5"))
    flagged = rewritten(
        plain,
        {
            "xl/workbook.xml": lambda s: s.replace(
                "<sheets>", '<workbookPr date1904="1"/><sheets>'
            )
        },
    )
    assert list(read_rows(flagged)) == [(0, ["2028-03-06 12:30:15.250000"])]


def test_discovery_is_recursive_and_case_sensitive(spark, folder):
    found = workbooks.discover_workbooks(spark, folder).select("path").collect()
    assert sorted(base(r.path) for r in found) == [
        "broken.xlsx",
        "deep.xlsx",
        "good.xlsx",
        "legacy.xls",
        "other_gate.xlsx",
    ]


def test_bad_files_are_set_aside(spark, folder):
    loaded = workbooks.ingest_workbooks(spark, folder)
    good, bad = conform.split_quarantine(loaded)
    assert sorted(base(r.source_path) for r in bad.collect()) == ["broken.xlsx", "legacy.xls"]
    row = good.where("tema_key = 'TK54RT54'").first()
    assert row.transaction_date == NOON
    assert (row.card_number, row.identifier, row.parameter_1) == ("1234567", None, "p")
    assert row.row_idx == 2


def test_files_that_spark_hides_are_named(spark, tmp_path):
    (tmp_path / "_2025").mkdir()
    for name in ("a.xlsx", "_b.xlsx", "_2025/c.xlsx", ".d.xls", "_e.txt"):
        (tmp_path / name).write_bytes(workbook_bytes(old_rows()))
    good, bad = conform.split_quarantine(workbooks.ingest_workbooks(spark, str(tmp_path)))
    assert [base(r.source_path) for r in good.collect()] == ["a.xlsx"]
    named = {base(r.source_path): r.load_error for r in bad.collect()}
    assert sorted(named) == [".d.xls", "_b.xlsx", "c.xlsx"]
    assert all(reason.startswith("Hidden") for reason in named.values())


def test_a_file_that_fails_late_is_dropped_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "_CHUNK", 2)
    broken = rewritten(
        workbook_bytes(old_rows() + [old_rows()[2]] * 5),
        {"xl/worksheets/sheet1.xml": lambda s: s.replace("</sheetData>", "<oops>")},
    )
    (tmp_path / "late.xlsx").write_bytes(broken)
    (tmp_path / "good.xlsx").write_bytes(workbook_bytes(old_rows() + [old_rows()[2]] * 5))
    handed = list(workbooks._read_workbook("late.xlsx", broken, workbooks.OLD_EXPORT))
    assert handed[-1].num_rows == 1 and handed[-1]["load_error"][0].as_py()
    good, bad = conform.split_quarantine(workbooks.ingest_workbooks(spark, str(tmp_path)))
    assert [base(r.source_path) for r in good.collect()] == ["good.xlsx"] * 6
    assert [base(r.source_path) for r in bad.collect()] == ["late.xlsx"]


def test_a_bad_date_cell_is_missing(spark, tmp_path):
    content = workbook_bytes(old_rows() + [old_rows()[2]])
    far = rewritten(
        content,
        {"xl/worksheets/sheet1.xml": lambda s: s.replace("<v>45356.5", "<v>99999999.5", 1)},
    )
    (tmp_path / "a.xlsx").write_bytes(far)
    tables = flow_from_folder(spark, str(tmp_path))
    assert tables["quarantine"].count() == 0
    assert [r.n for r in tables["untimed"].collect()] == [1]
    assert tables["counts"].where("hora = 12").first()[COUNT] == 1


def test_counted_exports_give_net_people(spark, tmp_path):
    for number in (4, 5):
        header = [f"Operator NN Date {number}/09/2025 Hour 11:08:56 p.m.", "Entradas", "Salidas"]
        content = workbook_bytes([header, [NOON, 3, number], [NOON, None, 1]])
        (tmp_path / f"{number}.xlsx").write_bytes(content)
    tables = flow_from_folder(spark, str(tmp_path), layout=workbooks.PRECOUNTED_EXPORT)
    (row,) = tables["people"].collect()
    assert (row.hora, row.entradas, row.salidas, row.personas_por_hora) == (12, 6, 11, -5)
    from gateflow.__main__ import main

    main([str(tmp_path), str(tmp_path / "out"), "--layout", "pre-counted", "--sigmas", "3"])
    assert spark.read.parquet(str(tmp_path / "out" / "people")).count() == 1


def test_empty_folder_stops(spark, tmp_path):
    with pytest.raises(ValueError, match="no .xls or .xlsx files"):
        workbooks.ingest_workbooks(spark, str(tmp_path))


def test_strict_layout_refuses_a_file_without_a_column(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes(old_rows()))
    short = [row[:5] for row in old_rows()]
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes(short))
    (tmp_path / "empty.xlsx").write_bytes(workbook_bytes([["Report"]]))
    strict = workbooks.ingest_workbooks(spark, str(tmp_path), workbooks.STRICT_OLD_EXPORT)
    good, bad = conform.split_quarantine(strict)
    assert [base(r.source_path) for r in good.collect()] == ["a.xlsx"]
    refused = {base(r.source_path): r.load_error for r in bad.collect()}
    assert refused["b.xlsx"] == "ValueError: missing columns: identifier, parameter_1"
    assert refused["empty.xlsx"].startswith("ValueError: missing columns: transit_")
    assert len(refused) == 2
    tolerant = workbooks.ingest_workbooks(spark, str(tmp_path))
    assert tolerant.where("load_error IS NULL").count() == 2


def test_new_format_ends_at_the_marker(spark, tmp_path):
    header = ["Temaline Interface", "Name", "When it was", "SAP Transit Flag", "Transit Status"]
    rows = [
        header,
        ["a", "TK54RT54", NOON, "Entry", 7],
        ["b", "TK54RT54", NOON, "Exit", 7],
        ["Views", None, None, None, None],
        ["c", "TK54RT54", NOON, "Exit", 7],
    ]
    (tmp_path / "new.xlsx").write_bytes(workbook_bytes(rows))
    (tmp_path / "first.xlsx").write_bytes(workbook_bytes([header, ["Views"], rows[1]]))
    loaded = workbooks.ingest_workbooks(spark, str(tmp_path), workbooks.NEW_EXPORT)
    found = loaded.orderBy("row_idx").collect()
    assert [(r.temaline_interface, r.operator, r.sap_transit_flag) for r in found] == [
        ("a", NOON, "Entry"),
        ("b", NOON, "Exit"),
    ]
    assert found[0].transit_status == "7"


def test_precounted_export_finds_its_time_column(spark, tmp_path):
    for number in (4, 5):
        header = [f"Operator NN Date {number}/09/2025 Hour 11:08:56 p.m.", "Entradas", "Salidas"]
        content = workbook_bytes([header, [NOON, 3, number], [NOON, None, 1]])
        (tmp_path / f"{number}.xlsx").write_bytes(content)
    loaded = workbooks.ingest_workbooks(spark, str(tmp_path), workbooks.PRECOUNTED_EXPORT)
    assert {r.ts for r in loaded.collect()} == {NOON}
    sums = loaded.agg(F.sum("entradas"), F.sum("salidas")).first()
    assert tuple(sums) == (6, 11)


def test_folder_to_net_flow(spark, folder, tmp_path):
    table = str(tmp_path / "loaded_table")
    tables = flow_from_folder(spark, folder, table=table)
    assert tables["counts"].count() == 2
    assert tables["quarantine"].count() == 2
    net = {r.hora: r.flujo_neto_ajustado for r in tables["net"].collect()}
    assert len(net) == 24 and net[11] == 0
    with pytest.raises(ValueError, match="no transactions"):
        flow_from_folder(spark, folder, gates=["nowhere"])
    bundle = {name: tables[name] for name in ("net", "hourly_net")}
    write_bundle(bundle, str(tmp_path / "bundle"))
    back = read_bundle(spark, str(tmp_path / "bundle"), ["net", "hourly_net"])
    assert sorted(back["net"].collect()) == sorted(tables["net"].collect())


def test_new_format_folder_to_net_flow(spark, tmp_path):
    header = ["Temaline Interface", "Name", "When", "SAP Transit Flag"]
    rows = [["t", "TK54RT54", NOON, "Entry"]] * 3 + [["t", "TK54RT54", NOON, "Exit"]]
    (tmp_path / "new.xlsx").write_bytes(workbook_bytes([header, *rows]))
    tables = flow_from_folder(spark, str(tmp_path), layout=workbooks.NEW_EXPORT)
    net = {r.hora: r.diferencia_neta for r in tables["hourly_net"].collect()}
    assert len(net) == 24 and net[11] == 0
    raw = tables["imputed"].where("hora = 12").select("sap_transit_flag", COUNT)
    assert dict(map(tuple, raw.collect())) == {"Entry": 3, "Exit": 1}


@pytest.mark.parametrize(
    ("text", "moment"),
    [
        ("2024-03-05 12:30:15.25", NOON),
        ("2024/3/5 12:30:15.25", NOON),
        ("2024.03.05T12:30:15.25", NOON),
        (" 2024-03-05 ", datetime(2024, 3, 5)),
        ("86400.5", datetime(1970, 1, 2, 0, 0, 0, 500_000)),
        ("yesterday", None),
        ("2024-13-01", None),
        (None, None),
    ],
)
def test_timestamps_from_text(spark, text, moment):
    df = spark.createDataFrame([(text,)], "t string")
    assert conform.conform_types(df, {"t": "timestamp_ntz"}).first().t == moment


def test_types_of_present_columns_only(spark):
    df = spark.createDataFrame([("7", "x")], "a string, b string")
    typed = conform.conform_types(df, {"a": "bigint", "b": "double", "c": "string"})
    assert typed.dtypes == [("a", "bigint"), ("b", "double")]
    assert tuple(typed.first()) == (7, None)
    with pytest.raises(ValueError, match="missing columns: c"):
        conform.conform_types(df, {"a": "bigint", "c": "string"}, strict=True)


def test_third_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert conform.rename_third(df).columns == ["a", "b", "operator"]
    assert conform.rename_third(df.select("a", "b")).columns == ["a", "b"]


def test_sentinel_cut_per_source(spark):
    rows = [("f", n, "Views" if n in (3, 5) else "x") for n in range(7)]
    rows += [("g", n, "x") for n in range(3)]
    rows += [("h", 0, "Views"), ("h", 1, "x"), (None, 0, "x"), (None, 1, "Views")]
    df = spark.createDataFrame(rows, "file string, n int, c string")
    kept = conform.sentinel_cut(df, "file", "n", F.col("c") == "Views").collect()
    found = sorted((r.file or "", r.n) for r in kept)
    assert found == [("", 0), ("f", 0), ("f", 1), ("f", 2), ("g", 0), ("g", 1), ("g", 2)]


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([(2.5, 2)], "d double, n int")
    rows = conform.union_by_name(a, b).select("n", "t", "d").collect()
    assert sorted(rows) == [(1, "x", None), (2, None, 2.5)]
