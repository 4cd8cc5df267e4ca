"""Exact top-k by inner product: a Voronoi kNN join.

Vectors and queries are grouped by their nearest pivot. A group's summary (its count
and the largest distance to its pivot) bounds every product with it: for a member x of
group j, q.x <= q.p + |q| * radius. A query first meets its own group, where its k-th
score is a floor; then it is sent to those other groups alone whose bound reaches the
floor. Of the two sides the queries are copied, as they are the fewer. Large groups
are dealt to several blocks, and a block takes a bounded number of queries at a time,
so no block grows with the data; blocks solve by a matrix product and keep k rows a
query, which are merged by a window over a query's few rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateflow.llm.tables import arrow_schema
from gateflow.session import store_table

_EXACT = float(1 << 53)
_FOUND = "query_row long, query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id, dim and v (long integers as bytes): floor(scale * x) of every x.

    Rows without a vec_id, a vector, or with a missing or non-finite component take no
    part.
    """
    sound = vectors.filter(
        "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> "
        "x IS NOT NULL AND NOT isnan(x) AND abs(x) <> CAST('Infinity' AS DOUBLE))"
    ).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    schema = "row long, vec_id long, dim int, v binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            values = column.flatten().to_numpy(zero_copy_only=False)
            whole = np.floor(scale * values).astype("<i8")
            sizes = np.diff(np.asarray(column.offsets))
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("vec_id"),
                    pa.array(sizes, pa.int32()),
                    pa.array(
                        [whole[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary()
                    ),
                ],
                schema=arrow_schema(schema),
            )

    return sound.mapInArrow(run, schema)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype="<i8").reshape(len(column), dim)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products of rows, by floats where these are exact."""
    if left.size and right.size:
        most = float(np.abs(left).max()) * float(np.abs(right).max()) * left.shape[1]
        if most < _EXACT:
            return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


def _grouped(stored: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each vector with its nearest pivot and the distance to it."""
    schema = "row long, vec_id long, dim int, v binary, cell int, away double"
    dim = pivots.shape[1]
    centres = pivots.astype(float)
    squares = (centres**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim).astype(float)
            cell = (squares - 2 * x @ centres.T).argmin(axis=1)
            away = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(away)],
                schema=arrow_schema(schema),
            )

    return stored.mapInArrow(run, schema)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; ``ids`` ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")][:k]


def _solve(asked: DataFrame, cells: DataFrame, counts: dict[int, int], k: int, dim: int, block_rows: int, block_queries: int) -> DataFrame:
    """Best k of each cell a query is sent to; ``asked`` has a query's row and a cell."""
    spark = asked.sparkSession
    per_cell = spark.createDataFrame(
        [(cell, n // block_rows + 1) for cell, n in counts.items()], "cell int, n_blocks int"
    )
    load = asked.groupBy("cell").count().select(
        "cell", (F.floor(F.col("count") / block_queries) + 1).cast("int").alias("n_rounds")
    )
    shape = store_table(per_cell.join(load, "cell"))
    sent = asked.join(F.broadcast(shape), "cell").select(
        F.col("cell").alias("to_cell"),
        F.col("row").alias("query_row"),
        F.col("vec_id").alias("query_id"),
        F.col("v").alias("q"),
        F.pmod(F.xxhash64("row"), F.col("n_rounds")).alias("to_round"),
        F.explode(F.expr("sequence(0, n_blocks - 1)")).alias("to_block"),
    )
    held = cells.join(F.broadcast(shape), "cell").select(
        "cell",
        "row",
        "vec_id",
        "v",
        F.pmod(F.xxhash64("row"), F.col("n_blocks")).cast("int").alias("block"),
        F.explode(F.expr("sequence(0L, CAST(n_rounds - 1 AS LONG))")).alias("round"),
    )

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if queries.num_rows and data.num_rows:
            data = data.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            ids, rows = (data.column(c).to_numpy() for c in ("vec_id", "row"))
            x = _matrix(data.column("v"), dim)
            own = queries.column("query_row").to_pylist()
            names = queries.column("query_id").to_pylist()
            q = _matrix(queries.column("q"), dim)
            for begin in range(0, len(own), 256):
                for i, scores in enumerate(_products(q[begin : begin + 256], x), begin):
                    best = _top(scores, ids, k + 1)
                    best = best[rows[best] != own[i]][:k]
                    out[0].extend([own[i]] * len(best))
                    out[1].extend([names[i]] * len(best))
                    out[2].extend(ids[best].tolist())
                    out[3].extend(scores[best].tolist())
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=arrow_schema(_FOUND))

    asking = sent.groupBy("to_cell", "to_block", "to_round")
    return asking.cogroup(held.groupBy("cell", "block", "round")).applyInArrow(solve, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def _join_one_size(
    stored: DataFrame, n: int, dim: int, every: int, k: int, most_pivots: int, block_rows: int, block_queries: int
) -> DataFrame:
    n_pivots = max(1, min(most_pivots, math.isqrt(n)))
    chosen = stored.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots)
    pivots = _matrix(chosen.select("v").toArrow().column("v"), dim)
    cells = store_table(_grouped(stored, pivots))
    summary = cells.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("away").alias("radius")
    ).toPandas()
    counts = dict(zip(summary["cell"].tolist(), summary["n"].tolist()))
    radius = np.full(n_pivots, -np.inf)
    radius[summary["cell"]] = summary["radius"]
    queries = cells.filter(F.pmod("vec_id", F.lit(every)) == 0)

    solve = (counts, k, dim, block_rows, block_queries)
    first = store_table(_best(_solve(queries, cells, *solve), k).drop("rank"))
    # A query that found fewer than k in its own cell has no floor yet.
    floors = first.groupBy("query_row").agg(
        F.when(F.count("*") >= k, F.min("score")).alias("floor")
    )
    waiting = queries.join(floors.withColumnRenamed("query_row", "row"), "row", "left")
    waiting = waiting.select("row", "vec_id", "v", "cell", "floor")
    schema = "row long, vec_id long, v binary, cell int"
    centres = pivots.astype(float)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("v"), dim).astype(float)
            norms = np.sqrt((q**2).sum(axis=1))
            floor = np.array(
                [-np.inf if f is None else f for f in batch.column("floor").to_pylist()]
            )
            # The slack covers the rounding of distances and products.
            bound = q @ centres.T + (norms * (1 + 1e-9))[:, None] * radius + 1e-3
            wanted = (bound >= floor[:, None]) & np.isfinite(radius)
            wanted[np.arange(len(q)), batch.column("cell").to_numpy()] = False
            place, cell = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(place)) for c in ("row", "vec_id", "v")),
                    pa.array(cell, pa.int32()),
                ],
                schema=arrow_schema(schema),
            )

    second = _solve(waiting.mapInArrow(reach, schema), cells, *solve)
    return _best(first.unionAll(second), k)


def knn_join(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    scale: int = 256,
    most_pivots: int = 256,
    block_rows: int = 20_000,
    block_queries: int = 4_000,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows of each query.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows
    but the query's own; rows that repeat a vec_id are rows of their own. Ties go to
    the smaller vec_id. Vectors meet only vectors of their length. Fewer than k
    candidates give fewer rows; an empty table gives none. Scores are exact while
    products fit a long integer.
    """
    stored = store_table(integer_vectors(vectors, scale))
    sizes = stored.groupBy("dim").count().orderBy("dim").collect()  # one row a length
    empty = stored.sparkSession.createDataFrame(
        [], "query_row long, query_id long, vec_id long, score long, rank int"
    )
    for size in sizes:
        one = stored.filter(F.col("dim") == size["dim"])
        empty = empty.unionByName(
            _join_one_size(one, size["count"], size["dim"], every, k, most_pivots, block_rows, block_queries)
        )
    return empty.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same rows from DuckDB.
KNN_SQL = """
WITH whole AS (
    SELECT row_number() OVER () AS row, vec_id,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id,
           CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank
    FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
