"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def few_rows_per_batch(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold at most ``rows`` rows, as single texts can be long.

    The memory of a task outside the heap is a few batches.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    few_rows_per_batch(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_columns(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a missing text as an empty one."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def give_back() -> None:
    """Return freed memory to the system, as Spark keeps a worker for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame, function: Callable[[dict], dict], schema: str, rows: int = 512
) -> DataFrame:
    """Apply ``function`` to columns as Python lists, some rows at a time.

    It gets a dict of lists and returns one for the columns of ``schema``. Few rows
    at a time bound the memory of a task where single texts are long.
    """
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(
                    function(batch.slice(at, rows).to_pydict()), schema=target
                )
        give_back()

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow schema of flat columns stated as ``name type, ...``."""
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "float": pa.float32(),
        "string": pa.string(),
        "binary": pa.binary(),
        "boolean": pa.bool_(),
    }

    def kind(name: str) -> pa.DataType:
        if name.startswith("array<"):
            return pa.list_(kind(name[6:-1]))
        return kinds[name]

    fields = (field.split(None, 1) for field in schema.split(","))
    return pa.schema([(name, kind(of.strip())) for name, of in fields])


def hash_remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a missing value as ''."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(text), F.lit(modulus))
