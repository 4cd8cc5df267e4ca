"""Session helpers: a local session, and intermediates written once."""

from __future__ import annotations

from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "gateflow") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _shared_folder(spark: SparkSession) -> str | None:
    """Checkpoint folder of the session, from ``spark.checkpoint.dir``, or None."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return None
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, on storage that outlives any executor.

    For small tables that a plan reads more than once, above all the hourly
    counts: without this each reference would scan the raw transactions again.
    Where the session names no shared folder, the table is cached instead, and
    recomputed if lost.
    """
    if _shared_folder(df.sparkSession) is None:
        return _kept(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df.checkpoint(eager=True)


def store_table(df: DataFrame) -> DataFrame:
    """Like ``materialise`` for large tables: parquet, with its pruning."""
    spark = df.sparkSession
    folder = _shared_folder(spark)
    if folder is None:
        return _kept(df.persist(StorageLevel.DISK_ONLY))
    path = f"{folder}/table-{uuid4()}"
    df.write.parquet(path)
    _paths.append(path)
    return spark.read.parquet(path)


def store_placed(
    df: DataFrame, keys: list[str], order: list[str], buckets: int | None = None
) -> DataFrame:
    """Like ``store_table``, with the rows of equal ``keys`` placed together, in order.

    The table is bucketed, so grouping, windows and joins by ``keys`` read it without a
    shuffle, which no checkpoint or plain folder remembers. ``buckets`` is the session's
    number of shuffle partitions unless stated. It lies in the shared folder, or in the
    warehouse where the session names none, until ``release``.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"placed_{uuid4().hex}"
    writer = (
        df.repartition(buckets, *keys)
        .write.format("parquet")
        .bucketBy(buckets, *keys)
        .sortBy(*keys, *order)
    )
    folder = _shared_folder(spark)
    if folder is not None:
        writer = writer.option("path", f"{folder}/{name}")
        _paths.append(f"{folder}/{name}")
    writer.saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


_frames: list[DataFrame] = []
_paths: list[str] = []
_tables: list[str] = []


def _kept(df: DataFrame) -> DataFrame:
    _frames.append(df)
    return df


def release(spark: SparkSession) -> None:
    """Give back what ``materialise``, ``store_table`` and ``store_placed`` hold.

    For long sessions, when the results that start from it are written. Frames made
    from a released table cannot be read any more.
    """
    while _frames:
        _frames.pop().unpersist()
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
