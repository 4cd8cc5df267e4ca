"""Vector codes by product quantisation: Lloyd's rounds on partition-local cover trees.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts. A
task gathers its vectors in blocks and builds, once, a cover tree over the distinct
points of each part: a node's children lie more than its scale apart and cover its
points within that scale, and a node's points stand next to each other, so running sums
over that order give the sum of every subtree. The trees are stored.

A round walks the trees from the root with the codebook's entries as candidates. By the
triangle inequality an entry further from a node's centre than the nearest entry by more
than two radii is nearest to none of its points. A node left with one candidate gives its
whole subtree to it, as one sum; only ambiguous nodes go on to their children, and the
points of ambiguous leaves are compared exactly with the candidates that are left. Tasks
add up their blocks and emit a sum for each part and entry, Spark adds these up, and the
codebook alone, whose size is a parameter, comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import arrow_schema
from gateflow.operators.joins import broadcast_if_small, left_join_null_safe
from gateflow.session import materialise, store_table

#: A node's children cover it within its radius over this.
BASE = 1.3
#: A node of so many points is not divided any more.
LEAF = 12

_EXACT = float(1 << 53)
_NODE = np.dtype(
    [("begin", "<i4"), ("end", "<i4"), ("centre", "<i4"), ("child", "<i4"),
     ("last", "<i4"), ("radius", "<f8")]
)


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, by floats where these are exact."""
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4.0 * float(most) ** 2 * points.shape[1] < _EXACT:
        x, c = points.astype(float), entries.astype(float)
        return (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)
    out = np.zeros((len(points), len(entries)), np.int64)
    for x, c in zip(points.T, entries.T):
        out += (x[:, None] - c) ** 2
    return out


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct points, and nodes as ranges of that order, the root first.

    A node's children stand next to each other; ``child == last`` marks a leaf.
    """
    x = points.astype(float)
    order = np.empty(len(points), np.int64)
    nodes: list[tuple] = []

    def away(rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))

    everything = np.arange(len(points))
    middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    waiting: list = [(middle, everything, away(everything, middle), 0)]
    while len(nodes) < len(waiting):
        centre, rows, far, begin = waiting[len(nodes)]
        waiting[len(nodes)] = None
        radius, end = far.max(), begin + len(rows)
        child = last = 0
        if len(rows) <= LEAF:
            order[begin:end] = rows
        else:
            child = len(waiting)
            scale, place, own = radius / BASE, begin, centre
            while len(rows):
                near = far <= scale
                waiting.append((own, rows[near], far[near], place))
                place += int(near.sum())
                rows = rows[~near]
                if len(rows):
                    own = int(rows[0])
                    far = away(rows, own)
            last = len(waiting)
        nodes.append((begin, end, centre, child, last, radius))
    place_of = np.empty(len(points), np.int64)
    place_of[order] = np.arange(len(points))
    out = np.array(nodes, _NODE)
    out["centre"] = place_of[out["centre"]]
    return order, out


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges."""
    sizes = ends - begins
    offsets = np.repeat(begins - np.cumsum(sizes) + sizes, sizes)
    return offsets + np.arange(sizes.sum())


def assign(
    points: np.ndarray, nodes: np.ndarray, entries: np.ndarray
) -> tuple[np.ndarray, int]:
    """Nearest entry of each point, ties to the lower index; exact comparisons made.

    ``points`` stand in the order of the tree.
    """
    nearest = np.empty(len(points), np.int64)
    # Of equal entries the first alone can be nearest; else none would ever be sure.
    _, firsts = np.unique(entries, axis=0, return_index=True)
    candidates = np.zeros((1, len(entries)), bool)
    candidates[0, firsts] = True
    active, compared = np.zeros(1, np.int64), 0
    while len(active):
        node = nodes[active]
        far = squared_distances(points[node["centre"]], entries).astype(float)
        far[~candidates] = np.inf
        best = far.argmin(axis=1)
        far = np.sqrt(far)
        reach = far[np.arange(len(best)), best] + 2 * node["radius"]
        # The slack covers the rounding of distances and radii.
        candidates = far <= (reach * (1 + 1e-9) + 1e-6)[:, None]
        sure = (candidates.sum(axis=1) == 1) | (node["end"] - node["begin"] == 1)
        won = node[sure]
        nearest[_ranges(won["begin"], won["end"])] = np.repeat(
            best[sure], won["end"] - won["begin"]
        )
        node, candidates = node[~sure], candidates[~sure]
        leaf = node["child"] == node["last"]
        rows = _ranges(node["begin"][leaf], node["end"][leaf])
        if len(rows):
            sizes = node["end"][leaf] - node["begin"][leaf]
            far = squared_distances(points[rows], entries).astype(float)
            far[~np.repeat(candidates[leaf], sizes, axis=0)] = np.inf
            nearest[rows] = far.argmin(axis=1)
            compared += len(rows)
        inner = node[~leaf]
        active = _ranges(inner["child"], inner["last"])
        candidates = np.repeat(candidates[~leaf], inner["last"] - inner["child"], axis=0)
    return nearest, compared


def assigned_sums(
    points: np.ndarray, weights: np.ndarray, nearest: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the points of each entry, by running sums.

    Neighbours in the tree's order share their entry in long runs; a run's sum is the
    difference of two running sums.
    """
    running = np.zeros((len(points) + 1, points.shape[1] + 1), np.int64)
    np.cumsum(points * weights[:, None], axis=0, out=running[1:, :-1])
    np.cumsum(weights, out=running[1:, -1])
    begins = np.flatnonzero(np.append(True, nearest[1:] != nearest[:-1]))
    ends = np.append(begins[1:], len(nearest))
    out = np.zeros((n, points.shape[1] + 1), np.int64)
    np.add.at(out, nearest[begins], running[ends] - running[begins])
    return out[:, :-1], out[:, -1]


_BLOCK = "vec_id array<long>, label array<string>, dim int, points array<binary>, nodes array<binary>, places array<binary>"


def _sound(vectors: DataFrame) -> DataFrame:
    """Rows with a vector all of whose components are finite numbers."""
    return vectors.filter(
        "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> "
        "x IS NOT NULL AND NOT isnan(x) AND abs(x) <> CAST('Infinity' AS DOUBLE))"
    ).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def _whole(x: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x), refused where squared distances would not fit."""
    out = np.floor(scale * x)
    dim = out.shape[-1]
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} parts")
    if out.size and 4 * np.abs(out).max() ** 2 * dim >= float(1 << 62):
        raise ValueError("components are too large for squared distances of 64 bits")
    return out.astype(np.int64)


def tree_blocks(
    vectors: DataFrame, scale: int = 1024, parts: int = 4, block_rows: int = 4096
) -> DataFrame:
    """Blocks of vectors, each with a cover tree for every part."""

    def block(ids: list, labels: list, x: np.ndarray) -> pa.RecordBatch:
        columns: dict = {"vec_id": [ids], "label": [labels], "dim": [x.shape[1]]}
        columns |= {"points": [[]], "nodes": [[]], "places": [[]]}
        for part in np.split(x, parts, axis=1):
            points, places = np.unique(part, axis=0, return_inverse=True)
            order, nodes = cover_tree(points)
            place_of = np.empty(len(order), "<i4")
            place_of[order] = np.arange(len(order))
            columns["points"][0].append(points[order].astype("<i8").tobytes())
            columns["nodes"][0].append(nodes.tobytes())
            columns["places"][0].append(place_of[places.ravel()].tobytes())
        return pa.RecordBatch.from_pydict(columns, schema=_block_schema())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}  # by length
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes := np.diff(np.asarray(batch.column("x").offsets)))
            rows = zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label")))
            for (vec_id, label), size, end in zip(rows, sizes.tolist(), ends.tolist()):
                ids, labels, xs = held.setdefault(size, ([], [], []))
                ids.append(vec_id)
                labels.append(label)
                xs.append(values[end - size : end].copy())
                if len(ids) == block_rows:
                    yield block(ids, labels, _whole(np.array(xs), scale, parts))
                    del held[size]
        for ids, labels, xs in held.values():
            yield block(ids, labels, _whole(np.array(xs), scale, parts))

    return _sound(vectors).mapInArrow(run, _BLOCK)


def _block_schema() -> pa.Schema:
    return arrow_schema(_BLOCK)


def _trees(row: dict, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Part, points, nodes and each row's place among the points."""
    width = row["dim"] // parts
    for part in range(parts):
        points = np.frombuffer(row["points"][part], "<i8").reshape(-1, width)
        nodes = np.frombuffer(row["nodes"][part], _NODE)
        yield part, points, nodes, np.frombuffer(row["places"][part], "<i4")


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: floors of the means; entries without points stay."""
    parts, n, width = books.shape
    schema = "part int, entry int, n long, sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(books.shape, np.int64)
        counts = np.zeros((parts, n), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for part, points, nodes, places in _trees(row, parts):
                    weights = np.bincount(places, minlength=len(points))
                    nearest, _ = assign(points, nodes, books[part])
                    total, count = assigned_sums(points, weights, nearest, n)
                    sums[part] += total
                    counts[part] += count
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "part": part,
                "entry": entry,
                "n": counts[part, entry],
                "sums": sums[part, entry].tolist(),
            },
            schema=arrow_schema(schema),
        )

    totals = blocks.mapInArrow(run, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    )
    out = books.copy()
    for part, entry, count, *sums in totals.collect():  # one row an entry at most
        out[part, entry] = np.floor_divide(sums, count)
    return out


def codebooks(
    vectors: DataFrame, blocks: DataFrame, scale: int, parts: int, entries: int, rounds: int
) -> np.ndarray:
    """Codebooks (part, entry, position) after ``rounds`` rounds.

    They start as the vectors of the smallest ids; rows of one id are ordered by their
    vectors, rows without an id come last.
    """
    order = [F.col("vec_id").asc_nulls_last(), "x"]
    chosen = _sound(vectors).orderBy(*order).limit(entries).select("x").collect()
    first = _whole(np.array([row["x"] for row in chosen], float), scale, parts)
    books = np.stack(np.split(first, parts, axis=1))
    for _ in range(rounds):
        books = _round(blocks, books)
    return books


def encoded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector."""
    parts = len(books)
    schema = "vec_id long, label string, code string, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["vec_id"])
                error, codes = np.zeros(n, np.int64), np.empty((n, parts), np.uint8)
                for part, points, nodes, places in _trees(row, parts):
                    nearest, _ = assign(points, nodes, books[part])
                    away = ((points - books[part][nearest]) ** 2).sum(axis=1)
                    error += away[places]
                    codes[:, part] = nearest[places]
                columns = {"vec_id": row["vec_id"], "label": row["label"], "error": error}
                columns["code"] = [code.tobytes().hex() for code in codes]
                yield pa.RecordBatch.from_pydict(columns, schema=arrow_schema(schema))

    return blocks.mapInArrow(run, schema)


def codebooks_sha256(books: np.ndarray) -> str:
    text = ",".join(map(str, books.ravel().tolist()))
    return hashlib.sha256(text.encode()).hexdigest()


def vector_codes(
    vectors: DataFrame,
    scale: int = 1024,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    block_rows: int = 4096,
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector.

    Rows whose vector is missing, empty or holds a missing or non-finite component are
    dropped. All other vectors must have one length, which ``parts`` divides, else a
    ValueError says so. Ties go to the entry of lower index; equal rows get equal codes;
    a missing vec_id stays missing. ``label_error`` is the error summed over the rows of
    one label, those without a label together. An empty table gives no rows. ``entries``
    is 256 at most, as a code has two digits a part.
    """
    if entries > 256:
        raise ValueError("a code of two hex digits has 256 values")
    spark = vectors.sparkSession
    blocks = store_table(tree_blocks(vectors, scale, parts, block_rows))
    lengths = [row["dim"] for row in blocks.select("dim").distinct().limit(9).collect()]
    if len(lengths) > 1:
        raise ValueError(f"vectors have different lengths: {sorted(lengths)}")
    if not lengths:
        return spark.createDataFrame(
            [],
            "vec_id long, code string, error long, label_error long, codebooks_sha256 string",
        )
    books = codebooks(vectors, blocks, scale, parts, entries, rounds)
    rows = store_table(encoded(blocks, books))
    by_label = materialise(rows.groupBy("label").agg(F.sum("error").alias("label_error")))
    return left_join_null_safe(rows, broadcast_if_small(by_label), ["label"]).select(
        "vec_id",
        "code",
        "error",
        "label_error",
        F.lit(codebooks_sha256(books)).alias("codebooks_sha256"),
    )


def _codes_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """The same rows from DuckDB: every round compares all pairs."""

    def nearest(r: int) -> str:
        return f"""a{r} AS (
            SELECT row, part, min_by(entry, (away, entry)) AS entry, min(away) AS away
            FROM (SELECT p.row, p.part, b.entry,
                         CAST(list_sum(list_transform(list_zip(p.v, b.v),
                              lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS away
                  FROM points p JOIN b{r} b ON p.part = b.part)
            GROUP BY row, part)"""

    def means(r: int) -> str:
        return f"""b{r + 1} AS (
            SELECT b.part, b.entry, coalesce(m.v, b.v) AS v
            FROM b{r} b LEFT JOIN (
                SELECT part, entry, list(mean ORDER BY place) AS v
                FROM (SELECT a.part, a.entry, x.place, CAST(floor(
                             (sum(x.value) - ((sum(x.value) % count(*)) + count(*)) % count(*))
                             / count(*)) AS BIGINT) AS mean
                      FROM a{r} a JOIN spread x ON a.row = x.row AND a.part = x.part
                      GROUP BY ALL)
                GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"""

    steps = [step for r in range(rounds) for step in (nearest(r), means(r))]
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (
    SELECT row, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v
    FROM kept, range({parts}) r(part)),
spread AS MATERIALIZED (
    SELECT row, part, unnest(v) AS value, generate_subscripts(v, 1) AS place FROM points),
b0 AS (SELECT part, row AS entry, v FROM points WHERE row < {entries}),
{", ".join(steps)},
{nearest(rounds)},
coded AS (
    SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
           CAST(sum(away) AS BIGINT) AS error
    FROM a{rounds} GROUP BY row),
book AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS sha
    FROM b{rounds})
SELECT k.vec_id, c.code, c.error,
       CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       book.sha AS codebooks_sha256
FROM kept k JOIN coded c ON k.row = c.row, book
"""


CODES_SQL = _codes_sql()
