"""Named results as a folder of parquet tables, whole or renewed by date.

``write_bundle`` writes plain tables once. ``renew_bundle`` writes what is new into
folders of a version and then a manifest, which names for every table and date the
version that holds it. Readers go by the latest complete manifest: files of dates that
were not renewed stay as they are, and a bundle that is being written, or was given up
half-way, is not seen. One writer of a bundle may run at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gateflow.sources.ledger import complete_versions

DATE = "fecha"
# A row without a day stands for the table, the others for the days it has.
MANIFEST = "name string, dated boolean, day string, version int, columns string"
_DAY, _NO_DATE = "__dia", "none"


def write_bundle(
    bundle: dict[str, DataFrame], folder: str, mode: str = "errorifexists"
) -> None:
    """One table per name. Tables with a date are written in date order, so
    that a reader of a date range skips files by their footer statistics."""
    for name, df in bundle.items():
        if DATE in df.columns:
            df = df.repartitionByRange(DATE).sortWithinPartitions(DATE)
        df.write.mode(mode).parquet(f"{folder}/{name}")


def _manifest(spark: SparkSession, folder: str, version: int) -> list:
    """The manifest's rows, one a table and day."""
    if not version:
        return []
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest/version={version}").collect()


def bundle_versions(spark: SparkSession, folder: str) -> list[int]:
    return complete_versions(spark, f"{folder}/_manifest")


def _write_days(df: DataFrame, path: str, days: set[str] | None) -> list[str]:
    """Write a folder for each day, or each of ``days``, that has rows; their names."""
    day = F.coalesce(F.col(DATE).cast("string"), F.lit(_NO_DATE))
    rows = df.withColumn(_DAY, day)
    if days is not None:
        rows = rows.where(F.col(_DAY).isin(list(days)))
    rows.repartition(_DAY).write.mode("overwrite").partitionBy(_DAY).parquet(path)
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in system.listStatus(root)]
    return sorted(n.removeprefix(f"{_DAY}=") for n in names if n.startswith(_DAY))


def renew_bundle(
    spark: SparkSession,
    bundle: dict[str, DataFrame],
    folder: str,
    dates: Iterable[date | None] | None = None,
) -> int:
    """Write ``bundle`` as a new version and return its number.

    With ``dates``, dated tables are renewed on these days alone (None is the day of rows
    without a date): a day that has no rows any more is gone, all other days stay. Tables
    without a date are written whole, and tables that the bundle does not name stay. The
    manifest has one row a table and day, and is put together on the driver.
    """
    version = max(bundle_versions(spark, folder), default=0)
    days = None if dates is None else {_NO_DATE if d is None else str(d) for d in dates}
    kept = [
        tuple(row)
        for row in _manifest(spark, folder, version)
        if row["name"] not in bundle
        or (days is not None and row["day"] is not None and row["day"] not in days)
    ]
    version += 1
    for name, df in bundle.items():
        path, dated = f"{folder}/{name}/version={version}", DATE in df.columns
        kept.append((name, dated, None, version, df.schema.json()))
        if dated:
            written = _write_days(df, path, days)
            kept += [(name, True, day, version, None) for day in written]
        else:
            df.write.mode("overwrite").parquet(path)
    entries = spark.createDataFrame(kept, MANIFEST)
    entries.coalesce(1).write.mode("overwrite").parquet(f"{folder}/_manifest/version={version}")
    return version


def read_bundle(
    spark: SparkSession, folder: str, names: list[str], version: int | None = None
) -> dict[str, DataFrame]:
    """Tables by name: of the latest complete version, or of an earlier one."""
    versions = bundle_versions(spark, folder)
    if not versions:
        return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    version = versions[-1] if version is None else version
    if version not in versions:
        raise ValueError(f"version {version} of {folder} is not complete")
    entries = _manifest(spark, folder, version)
    return {name: _read_table(spark, folder, name, entries) for name in names}


def _read_table(spark: SparkSession, folder: str, name: str, entries: list) -> DataFrame:
    """The folders that the manifest names; no other file of the table is opened."""
    own = [entry for entry in entries if entry["name"] == name]
    table = next((entry for entry in own if entry["day"] is None), None)
    if table is None:
        raise ValueError(f"{folder} has no table {name}")
    schema = StructType.fromJson(json.loads(table["columns"]))
    if table["dated"]:
        parts = [(e["version"], f"/{_DAY}={e['day']}") for e in own if e["day"] is not None]
    else:
        parts = [(table["version"], "")]
    paths = [f"{folder}/{name}/version={v}{place}" for v, place in parts]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)
