"""Loading again only what changed.

A ledger has a row for each loaded file: path, length, time, digest, and the batch whose
rows are the file's. A refresh lists the folder without reading any file, reads those
alone that the ledger does not know with this length and time, decodes those alone whose
digest is new, and writes their rows as one more batch. The rows of a file are those of
the batch its ledger row names, so a changed file replaces its own rows and a removed
one takes its rows along, while the rows of all others stay where they are.

A refresh becomes visible with its ledger, which is written last and counts only when it
is complete; a run that fails before leaves the table as it was. One refresh of a table
may run at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gateflow.functions.text import value as literal
from gateflow.operators.counts import require_rows
from gateflow.operators.joins import broadcast_if_small
from gateflow.session import materialise
from gateflow.sources.tallies import tallied
from gateflow.sources.workbooks import (
    OLD_EXPORT,
    Layout,
    decode_workbooks,
    discover_workbooks,
    hidden_workbooks,
    type_records,
    whole_files,
)

LEDGER = "path string, length bigint, modified timestamp, digest string, batch string"


def file_changes(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """path and status of every file in the listing, the ledger or both.

    Both have path, length, modified and digest. Length and time decide first, as they
    are known without reading: ``same``, else ``touched`` where the digest is the old
    one, else ``changed``; ``new`` and ``removed`` are in one of the two only.
    """
    known = ledger.select(
        *[F.col(c).alias(f"old_{c}") for c in ("path", "length", "modified", "digest")]
    )
    status = (
        "CASE WHEN path IS NULL THEN 'removed' WHEN old_path IS NULL THEN 'new' "
        "WHEN length <=> old_length AND modified <=> old_modified THEN 'same' "
        "WHEN digest = old_digest THEN 'touched' ELSE 'changed' END"
    )
    joined = listing.join(known, F.expr("path = old_path"), "full_outer")
    return joined.selectExpr("coalesce(path, old_path) AS path", f"{status} AS status")


def live_rows(rows: DataFrame, ledger: DataFrame, source: str = "source_path") -> DataFrame:
    """The rows that the ledger names: each file's rows of its own batch."""
    wanted = ledger.select(F.col("path").alias(source), "batch")
    return rows.join(broadcast_if_small(wanted), [source, "batch"], "left_semi")


@dataclass(frozen=True)
class Refreshed:
    """The table after a refresh: its ledgers before and now, and the new batch.

    ``batch`` is None if no file had to be decoded. ``tally`` counts the new batch.
    """

    table: str
    version: int
    batch: str | None
    before: DataFrame
    ledger: DataFrame
    tally: dict = field(default_factory=dict)

    def changes(self) -> DataFrame:
        """path and status of the files."""
        return file_changes(self.ledger, self.before)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def complete_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the ``version=N`` folders whose write has ended."""
    root = _path(spark, folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    found = []
    for entry in system.listStatus(root):
        match = re.match(r"version=(\d+)$", entry.getPath().getName())
        if match and system.exists(_path(spark, f"{folder}/{match[0]}/_SUCCESS")):
            found.append(int(match[1]))
    return sorted(found)


def read_ledger(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The latest ledger, or that of ``version``; empty if there is none."""
    if version is None:
        version = max(complete_versions(spark, f"{table}/ledger"), default=0)
    if not version:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{table}/ledger/version={version}")


def read_batches(
    spark: SparkSession, table: str, kind: str, schema: str, ledger: DataFrame
) -> DataFrame:
    """Rows of ``kind`` that the ledger names; other batches are not opened."""
    batches = [r[0] for r in ledger.select("batch").distinct().collect()]  # one a refresh
    paths = [f"{table}/{kind}/batch={batch}" for batch in batches]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(""))
    stored = spark.read.schema(schema).option("basePath", f"{table}/{kind}").parquet(*paths)
    return live_rows(stored.withColumn("batch", F.col("batch").cast("string")), ledger)


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files by name; signs that would make a pattern of a name stand for themselves."""
    plain = [re.sub(r"([{}\[\]*?\\])", r"\\\1", path) for path in paths]
    return spark.read.format("binaryFile").load(plain)


def loaded_schema(layout: Layout) -> str:
    typed = ", ".join(f"`{name}` {kind}" for name, kind in layout.types.items())
    return f"source_path string, row_idx bigint, {typed}, load_error string"


def refresh_workbooks(
    spark: SparkSession,
    folder: str,
    table: str,
    layout: Layout = OLD_EXPORT,
    gates: Iterable[str] | None = None,
) -> Refreshed:
    """Bring ``table`` up to date with the exports below ``folder``.

    Files that are new or of another length or time are read for their digest, and once
    more for their cells if the digest is new. Their names come to the driver, as they do
    for any list of files that Spark reads. ``gates`` matter to the tally only.
    """
    version = max(complete_versions(spark, f"{table}/ledger"), default=0)
    before = read_ledger(spark, table, version)
    listing = discover_workbooks(spark, folder).select(
        "path", "length", F.col("modificationTime").alias("modified")
    )
    if not version and not hidden_workbooks(spark, folder):
        require_rows(listing, f"no .xls or .xlsx files below {folder}")
    listing = materialise(listing)
    unknown = listing.join(before, ["path", "length", "modified"], "left_anti")
    suspects = [row["path"] for row in unknown.select("path").collect()]
    if not suspects and listing.count() == before.count():
        return Refreshed(table, version, None, before, before)

    hashed = spark.createDataFrame([], "path string, digest string")
    if suspects:
        contents = _contents(spark, suspects)
        hashed = materialise(contents.select("path", F.sha2("content", 256).alias("digest")))
    changed = [
        row["path"] for row in hashed.join(before, ["path", "digest"], "left_anti").collect()
    ]
    batch, counted = None, {}
    if changed:
        batch = str(uuid4())
        files = _contents(spark, changed).select("path", "content")
        rows = files.transform(decode_workbooks, layout).transform(type_records, layout)
        tally = Observation()
        rows = tallied(rows, layout, gates, tally)
        rows.write.parquet(f"{table}/rows/batch={batch}")
        counted = tally.get

    old = before.select("path", F.col("digest").alias("old_digest"), F.col("batch").alias("old_batch"))
    kept = "digest IS NULL OR digest <=> old_digest"
    entries = (
        listing.join(hashed, "path", "left")
        .join(old, "path", "left")
        .selectExpr(
            "path",
            "length",
            "modified",
            "coalesce(digest, old_digest) AS digest",
            f"IF({kept}, old_batch, {literal(batch)}) AS batch",
        )
    )
    version += 1
    entries.coalesce(1).write.parquet(f"{table}/ledger/version={version}")
    now = read_ledger(spark, table, version)
    return Refreshed(table, version, batch, before, now, counted)


def refreshed_rows(
    spark: SparkSession, refreshed: Refreshed, folder: str, layout: Layout = OLD_EXPORT
) -> DataFrame:
    """All rows of the folder as ``ingest_workbooks`` gives them, from the batches."""
    schema = loaded_schema(layout)
    rows = read_batches(spark, refreshed.table, "rows", schema, refreshed.ledger)
    passed = spark.createDataFrame(
        [
            (path, "Hidden: a name that begins with _ or a dot")
            for path in hidden_workbooks(spark, folder)
        ],
        "source_path string, load_error string",
    )
    return whole_files(rows.drop("batch")).unionByName(passed, allowMissingColumns=True)
