"""Folders of spreadsheet exports as one Spark ingest job.

Spark lists the files, spreads them over the tasks and types the cells; only
the cell codec is Python. A workbook cannot be split: a task reads the files it was
given one after the other, and hands the rows of a sheet on in chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.functions.text import value as literal
from gateflow.operators.counts import DIRECTION, TIMESTAMP, require_rows
from gateflow.operators.joins import broadcast_if_small
from gateflow.session import store_table
from gateflow.sources.conform import parse_timestamp
from gateflow.sources.names import clean_names, number_headers
from gateflow.sources.xlsx import read_rows

_CHUNK = 20_000


@dataclass(frozen=True)
class Layout:
    """How one kind of export is laid out.

    ``skip`` banner rows precede the header. ``positions`` names columns by
    place and ``prefixes`` by the start of their cleaned name. A file without
    a ``required`` column is refused. ``sentinel`` is a column and the value
    with which the data of a file end. Columns outside ``types`` are not kept.
    """

    types: dict[str, str]
    gate: str | None
    timestamp: str
    direction: str | None
    skip: int = 0
    required: tuple[str, ...] = ()
    positions: dict[int, str] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)
    sentinel: tuple[str, str] | None = None


# Column names and types of the known exports (fixed values).
OLD_EXPORT = Layout(
    types={
        "tema_key": "string",
        "transaction_date": "timestamp_ntz",
        "transit_direction_description": "string",
        "transit_status_description": "string",
        "card_number": "string",
        "identifier": "string",
        "parameter_1": "string",
    },
    gate="tema_key",
    timestamp=TIMESTAMP,
    direction=DIRECTION,
    skip=1,
)
# The same, refusing files that lack one of these columns.
STRICT_OLD_EXPORT = replace(
    OLD_EXPORT,
    required=(
        "transit_status_description",
        "card_number",
        "identifier",
        "parameter_1",
        "transaction_date",
    ),
)
NEW_EXPORT = Layout(
    types={
        "temaline_interface": "string",
        "operator": "timestamp_ntz",
        "name": "string",
        "sap_transit_flag": "string",
        "transits": "string",
        "card_number": "string",
        "transaction_date": "timestamp_ntz",
        "transit_status": "string",
    },
    gate="name",
    timestamp="operator",
    direction="sap_transit_flag",
    positions={2: "operator"},
    sentinel=("temaline_interface", "Views"),
)
PRECOUNTED_EXPORT = Layout(
    types={"ts": "timestamp_ntz", "entradas": "bigint", "salidas": "bigint"},
    gate=None,
    timestamp="ts",
    direction=None,
    prefixes={"operator_nn_date": "ts"},
)


def discover_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Files below ``folder`` that end in .xls or .xlsx, in lower case."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{xls,xlsx}")
        .load(folder)
    )


def hidden_workbooks(spark: SparkSession, folder: str) -> list[str]:
    """Such files that Spark passes over: a name on their way begins with _ or a dot.

    The file system lists them, on the driver as Spark's own listing does.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    top = system.makeQualified(root).toString().rstrip("/")
    found, files = [], system.listFiles(root, True)
    while files.hasNext():
        path = files.next().getPath().toString()
        below = path.removeprefix(top).strip("/").split("/")
        if path.endswith((".xls", ".xlsx")) and any(n.startswith(("_", ".")) for n in below):
            found.append(path)
    return sorted(found)


def _header(cells: list[str | None], layout: Layout) -> list[str]:
    names = number_headers(cells)
    for position, name in layout.positions.items():
        if position < len(names):
            names[position] = name
    names = clean_names(names)
    for prefix, name in layout.prefixes.items():
        names = [name if n.startswith(prefix) else n for n in names]
    absent = [name for name in layout.required if name not in names]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return names


def records_schema(layout: Layout) -> str:
    """Sheet rows: a text column for each wanted one."""
    texts = "".join(f"`{name}` string, " for name in layout.types)
    return f"source_path string, row_idx bigint, {texts}load_error string"


def _batch(path: str, layout: Layout, rows: list, error: str | None = None):
    """``rows`` are pairs of a row number and the cells of the wanted columns."""
    names = ["source_path", "row_idx", *layout.types, "load_error"]
    wanted = zip(*(cells for _, cells in rows)) if rows else [()] * len(layout.types)
    return pa.record_batch(
        [
            pa.array([path] * len(rows), pa.string()),
            pa.array([number for number, _ in rows], pa.int64()),
            *(pa.array(list(cells), pa.string()) for cells in wanted),
            pa.array([error] * len(rows), pa.string()),
        ],
        names=names,
    )


def _read_workbook(
    path: str, content: bytes, layout: Layout
) -> Iterator[pa.RecordBatch]:
    """Rows of one workbook in chunks; a failure adds a row with its reason.

    A workbook may fail after some of its chunks were handed on; ``whole_files``
    drops these. The task sees the rows in order, so the layout's marker is found on
    the way.
    """
    marker_column, marker = layout.sentinel or (None, None)
    try:
        if not content.startswith(b"PK"):
            raise ValueError("not an .xlsx workbook")
        places, rows, marker_at, ended = None, [], None, False
        for number, cells in read_rows(content):
            if number < layout.skip or ended:
                continue
            if places is None:
                names = _header(cells, layout)
                places = [names.index(n) if n in names else None for n in layout.types]
                if marker_column in names:
                    marker_at = names.index(marker_column)
                continue
            if marker_at is not None and marker_at < len(cells):
                ended = cells[marker_at] == marker
                if ended:
                    continue
            width = len(cells)
            picked = [cells[p] if p is not None and p < width else None for p in places]
            rows.append((number, picked))
            if len(rows) == _CHUNK:
                yield _batch(path, layout, rows)
                rows = []
        if places is None:
            _header([], layout)
        if rows:
            yield _batch(path, layout, rows)
    except MemoryError:  # a fault of the machine, not of the file
        raise
    except Exception as failure:  # any fault of one file must spare the others
        reason = f"{type(failure).__name__}: {failure}"
        yield _batch(path, layout, [(None, [None] * len(layout.types))], reason)


def decode_workbooks(files: DataFrame, layout: Layout = OLD_EXPORT) -> DataFrame:
    """Sheet rows of files given as (path, content), one text column per wanted one.

    A column that a file lacks is NULL. An unreadable file, or one without a required
    column, gives a row with ``load_error``.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield from _read_workbook(path.as_py(), content.as_py(), layout)

    return files.select("path", "content").mapInArrow(decode, records_schema(layout))


def cells_by_name(records: DataFrame, layout: Layout = OLD_EXPORT) -> DataFrame:
    """Text columns from rows that carry their header and cells as arrays.

    For rows of sheets that were not decoded here: ``columns`` is the cleaned header
    of the row's file, so files with different headers form one table.
    """
    place = "CAST(array_position(columns, {}) - 1 AS INT)"
    cells = [
        F.expr(f"get(cells, {place.format(literal(name))})").alias(name)
        for name in layout.types
    ]
    return records.select("source_path", "row_idx", *cells, "load_error")


def whole_files(loaded: DataFrame) -> DataFrame:
    """``loaded`` without the rows of files that failed later on."""
    failed = loaded.where("load_error IS NOT NULL").select(
        F.col("source_path").alias("__failed")
    )
    failed = broadcast_if_small(failed.distinct())
    partly = F.col("source_path").eqNullSafe(F.col("__failed"))
    partly &= F.col("load_error").isNull()
    return loaded.join(failed, partly, "left_anti")


def type_records(records: DataFrame, layout: Layout = OLD_EXPORT) -> DataFrame:
    """Text columns of sheet rows with the types of the layout; bad cells are NULL."""

    def typed(name: str, wanted: str):
        if wanted == "timestamp_ntz":
            return parse_timestamp(F.col(name))
        if wanted == "string":
            return F.col(name)
        return F.col(name).try_cast("decimal(38,6)").try_cast(wanted)

    return records.select(
        "source_path",
        "row_idx",
        *[typed(name, wanted).alias(name) for name, wanted in layout.types.items()],
        "load_error",
    )


def ingest_workbooks(
    spark: SparkSession,
    folder: str,
    layout: Layout = OLD_EXPORT,
    table: str | None = None,
    watch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All exports below ``folder`` as one table with a ``load_error`` column.

    The rows are written to ``table`` as parquet, or to the session's shared folder,
    so that workbooks are decoded once however often the result is used. A file that
    fails, or that Spark passes over for its name, gives one row with the reason.
    ``watch`` may add observed counters to the rows that are written.
    """
    hidden = hidden_workbooks(spark, folder)
    files = discover_workbooks(spark, folder).select("path", "content")
    if not hidden:
        files = require_rows(files, f"no .xls or .xlsx files below {folder}")
    rows = files.transform(decode_workbooks, layout).transform(type_records, layout)
    if watch is not None:
        rows = watch(rows)
    if table is None:
        rows = store_table(rows)
    else:
        rows.write.mode("errorifexists").parquet(table)
        rows = spark.read.parquet(table)
    passed = spark.createDataFrame(
        [(path, "Hidden: a name that begins with _ or a dot") for path in hidden],
        "source_path string, load_error string",
    )
    return whole_files(rows).unionByName(passed, allowMissingColumns=True)
