"""Ranked lexical search by pipelined term partitioning.

The index is partitioned by term: every term belongs to one of a few owner stages, the
terms of highest weight to the first. Documents that were read together form a shard,
items are taken in groups, and a bundle carries the sparse accumulators (document,
integer score) of a group's items over one shard from owner to owner. An owner's stage is
a cogroup of the bundles with its postings: it adds the contributions of its terms and
hands the bundle on.

A bundle drops an accumulator only if that cannot change the result. Each term's
contribution has an upper bound, and between stages the scores so far give each item a
floor that at least k documents have reached already; an accumulator whose score and the
bounds of all later owners together stay below the floor cannot be among the k best. So
common terms, which most documents hold, add to few accumulators. The last stage keeps
the k best of each shard, and a window ranks what is left.

Missing texts have no terms. An item without terms that occur has no result rows, rows
that repeat an item_id or a doc_id stay rows of their own, equal scores are ordered by
doc_id, those without one last. Columns beside the ids and texts are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateflow.llm.tables import arrow_schema
from gateflow.operators.joins import broadcast_if_small, measured_bytes
from gateflow.session import materialise, store_table

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TERMS = bytearray(range(256))
_TERMS[ord("A") : ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
for _code in _SEPARATORS:
    if not ord("A") <= _code <= ord("Z"):
        _TERMS[_code] = ord(" ")
_TERMS = bytes(_TERMS)

_POSTINGS = (
    "shard long, term string, df int, docs binary, tfs binary, most int, least double, "
    "ids array<long>, lengths binary, n_docs long, n_terms long"
)
_BUNDLE = "group int, shard long, slot int, docs binary, scores binary, levels array<long>"
_FOUND = "group int, slot int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, letters (A-Z lower-cased) and all beyond ASCII."""
    return (text or b"").translate(_TERMS).split()


def numbered_items(items: DataFrame, group_items: int) -> DataFrame:
    """item_id, group, slot and distinct terms of each item that has terms."""
    schema = "item_id long, terms array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [[t.decode() for t in dict.fromkeys(terms_of(x))] for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(found, pa.list_(pa.string()))],
                schema=arrow_schema(schema),
            )

    read = items.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    kept = materialise(
        read.mapInArrow(run, schema)
        .filter("size(terms) > 0")
        .withColumn("row", F.monotonically_increasing_id())
    )
    n_groups = kept.count() // group_items + 1
    within = Window.partitionBy("group").orderBy("row")
    return (
        kept.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("int"))
        .withColumn("slot", F.row_number().over(within) - 1)
        .drop("row")
    )


def postings_by_shard(
    docs: DataFrame, wanted: frozenset[bytes] | None = None, shard_docs: int = 4096
) -> DataFrame:
    """Postings of each shard, a row a term, and a row with the shard's documents.

    A shard is up to ``shard_docs`` documents that a task reads one after the other.
    ``wanted`` leaves out other terms; None keeps all. ``most`` and ``least`` are the
    highest frequency of a term and the smallest ratio of length to frequency.
    """
    schema = arrow_schema(_POSTINGS)
    most_postings = 200 * shard_docs

    def shard_rows(shard: int, ids: list, lengths: list, found: dict) -> pa.RecordBatch:
        rows: dict[str, list] = {name: [] for name in schema.names}
        sizes = np.array(lengths, np.int64)
        for term, (docs, tfs) in found.items():
            places, counts = np.array(docs, "<u2"), np.array(tfs, "<i4")
            rows["term"].append(term.decode())
            rows["df"].append(len(docs))
            rows["docs"].append(places.tobytes())
            rows["tfs"].append(counts.tobytes())
            rows["most"].append(int(counts.max()))
            rows["least"].append(float((sizes[places] / counts).min()))
        for name in ("ids", "lengths", "n_docs", "n_terms"):
            rows[name] = [None] * len(found)
        for name in ("term", "df", "docs", "tfs", "most", "least"):
            rows[name].append(None)
        rows["ids"].append(ids)
        rows["lengths"].append(sizes.astype("<i8").tobytes())
        rows["n_docs"].append(int((sizes > 0).sum()))
        rows["n_terms"].append(int(sizes.sum()))
        rows["shard"] = [shard] * (len(found) + 1)
        return pa.RecordBatch.from_pydict(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        ids: list = []
        lengths: list = []
        found: dict[bytes, tuple[list, list]] = {}
        n_postings = 0
        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                terms = terms_of(text)
                counts = Counter(terms if wanted is None else filter(wanted.__contains__, terms))
                for term, tf in counts.items():
                    held = found.get(term)
                    if held is None:
                        held = found[term] = ([], [])
                    held[0].append(len(ids))
                    held[1].append(tf)
                ids.append(doc_id)
                lengths.append(len(terms))
                n_postings += len(counts)
                if len(ids) == shard_docs or n_postings >= most_postings:
                    yield shard_rows(shard, ids, lengths, found)
                    ids, lengths, found, n_postings = [], [], {}, 0
                    shard += 1
        if ids:
            yield shard_rows(shard, ids, lengths, found)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
    ).mapInArrow(run, _POSTINGS)


def weighted_terms(index: DataFrame, n: int, length: int, stages: int) -> DataFrame:
    """term, weight, bound of its contributions, and stage of each term that counts.

    Equal ranges of weight make the stages, the highest first. The bound takes the
    highest frequency and the smallest length a frequency together, although they may
    belong to different documents.
    """
    terms = index.filter("term IS NOT NULL").groupBy("term").agg(
        F.sum("df").alias("df"), F.max("most").alias("most"), F.min("least").alias("least")
    )
    ratio = f"(49D / most + 50D * {n} / {length} * least)"
    top = f"ln((2D * {n} + 2) / 3) * 1000"
    return (
        terms.selectExpr(
            "term",
            f"CAST(floor(1000 * ln((2D * {n} + 2) / (2D * df + 1))) AS LONG) AS weight",
            f"CAST(1000000000D / (1000 + 20 * {ratio}) AS LONG) + 1 AS share",
        )
        .filter("weight > 0")
        .selectExpr(
            "term",
            "weight",
            "weight * share AS bound",
            f"CAST(greatest(0, {stages - 1} - floor({stages} * weight / ({top} + 1))) AS INT) "
            "AS stage",
        )
    )


def _level(scores: np.ndarray) -> np.ndarray:
    """Scores with all but their 8 highest bits cleared."""
    low = np.maximum(np.frexp(scores.astype(float))[1] - 8, 0)
    return scores >> low << low


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _owner_stage(
    bundles: DataFrame, arriving: DataFrame, n: int, length: int, k: int, last: bool
) -> DataFrame:
    """Bundles after one owner has added its contributions; at last the k best."""
    missing = np.iinfo(np.int64).max

    def add(held: pa.Table, postings: pa.Table) -> pa.Table:
        out: dict[str, list] = {"slot": []}
        out |= {"doc_id": [], "score": []} if last else {"docs": [], "scores": [], "levels": []}
        rows = postings.to_pylist()
        header = next((row for row in rows if row["lengths"] is not None), None)
        if header is not None and (held.num_rows or len(rows) > 1):
            sizes = np.frombuffer(header["lengths"], "<i8")
            m = 50 + 50 * sizes * n // length
            floor, rest = (np.array(header[c], np.int64) for c in ("floors", "rests"))
            scores = np.zeros((len(floor), len(sizes)), np.int64)
            for row in held.to_pylist():
                docs = np.frombuffer(row["docs"], "<u2")
                scores[row["slot"], docs] = np.frombuffer(row["scores"], "<i8")
            for row in rows:
                if row["lengths"] is None:
                    docs = np.frombuffer(row["docs"], "<u2")
                    tf = np.frombuffer(row["tfs"], "<i4").astype(np.int64)
                    gain = row["weight"] * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
                    for slot in row["slots"]:
                        scores[slot, docs] += gain
            kept = (scores > 0) & (scores + rest[:, None] >= floor[:, None])
            ids = header["ids"] if last else []
            order = np.array([missing if i is None else i for i in ids], np.int64)
            for slot in np.flatnonzero(kept.any(axis=1)).tolist():
                docs = np.flatnonzero(kept[slot])
                values = scores[slot, docs]
                if last:
                    best = _best(values, order[docs], k)
                    out["slot"] += [slot] * len(best)
                    out["doc_id"] += [ids[d] for d in docs[best].tolist()]
                    out["score"] += values[best].tolist()
                else:
                    out["slot"].append(slot)
                    out["docs"].append(docs.astype("<u2").tobytes())
                    out["scores"].append(values.astype("<i8").tobytes())
                    top = np.partition(values, len(values) - k)[-k:] if len(values) > k else values
                    out["levels"].append(_level(top).tolist())
        here = len(out["slot"])
        key = postings if postings.num_rows else held
        out["group"] = [key.column("group")[0].as_py()] * here if here else []
        if not last:
            out["shard"] = [key.column("shard")[0].as_py()] * here if here else []
        return pa.Table.from_pydict(out, schema=arrow_schema(_FOUND if last else _BUNDLE))

    keys = ("group", "shard")
    return (
        bundles.groupBy(*keys)
        .cogroup(arriving.groupBy(*keys))
        .applyInArrow(add, _FOUND if last else _BUNDLE)
    )


def _floors(bundles: DataFrame, k: int) -> DataFrame:
    """For each item a score that at least k documents have reached already."""
    counts = (
        bundles.select("group", "slot", F.explode("levels").alias("level"))
        .groupBy("group", "slot", "level")
        .count()
    )
    down = Window.partitionBy("group", "slot").orderBy(F.desc("level"))
    reached = F.sum("count").over(down.rowsBetween(Window.unboundedPreceding, 0))
    return (
        counts.withColumn("reached", reached)
        .filter(F.col("reached") >= k)
        .groupBy("group", "slot")
        .agg(F.max("level").alias("floor"))
    )


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    stages: int = 5,
    group_items: int = 256,
    shard_docs: int = 4096,
    term_bytes: int = 16 << 20,
) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each item.

    The items' terms go to the tasks that read documents if their bytes, measured first,
    are at most ``term_bytes``; otherwise the postings of all terms meet the items' terms
    in a join. Only documents with a score above 0 count. An empty table gives no rows.
    """
    spark = docs.sparkSession
    asked = materialise(numbered_items(items, group_items))
    pairs = asked.select("group", "slot", F.explode("terms").alias("term"))
    wanted = materialise(pairs.select("term").distinct())
    if measured_bytes(wanted) <= term_bytes:
        known = frozenset(row["term"].encode() for row in wanted.collect())
        index = store_table(postings_by_shard(docs, known, shard_docs))
    else:
        every = store_table(postings_by_shard(docs, None, shard_docs))
        index = store_table(
            every.join(wanted, "term", "left_semi")
            .select(*every.columns)
            .unionAll(every.filter("term IS NULL"))
        )
    n, length = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    result = "item_id long, rank int, doc_id long, score long"
    if not n or asked.isEmpty():
        return spark.createDataFrame([], result)

    terms = materialise(weighted_terms(index, n, length, stages))
    known_pairs = materialise(pairs.join(terms, "term"))
    owned = broadcast_if_small(
        known_pairs.groupBy("group", "term", "weight", "stage").agg(
            F.collect_list("slot").alias("slots")  # as many as a group has items at most
        )
    )
    later = materialise(
        known_pairs.groupBy("group", "slot").agg(
            *[
                F.sum(F.when(F.col("stage") > s, F.col("bound")).otherwise(0)).alias(f"rest{s}")
                for s in range(stages)
            ]
        )
    )
    postings = store_table(
        index.filter("term IS NOT NULL")
        .select("shard", "term", "docs", "tfs")
        .join(owned, "term")
        .select("group", "shard", "stage", "weight", "docs", "tfs", "slots")
    )
    last_group = asked.agg(F.max("group")).first()[0]
    headers = index.filter("term IS NULL").select("shard", "ids", "lengths")

    bundles = spark.createDataFrame([], _BUNDLE)
    for s in range(stages):
        last = s == stages - 1
        state = asked.select("group", "slot").join(
            later.select("group", "slot", F.col(f"rest{s}").alias("rest")), ["group", "slot"], "left"
        )
        if s:
            state = state.join(_floors(bundles, k), ["group", "slot"], "left")
        else:
            state = state.withColumn("floor", F.lit(0))
        row = F.struct(
            "slot",
            F.coalesce("floor", F.lit(0)).cast("long").alias("floor"),
            F.coalesce("rest", F.lit(0)).cast("long").alias("rest"),
        )
        programs = state.groupBy("group").agg(F.sort_array(F.collect_list(row)).alias("x"))
        programs = materialise(programs.selectExpr("group", "x.floor AS floors", "x.rest AS rests"))
        shards = headers.select(
            F.explode(F.sequence(F.lit(0), F.lit(last_group))).alias("group"),
            "shard",
            F.col("ids") if last else F.lit(None).cast("array<long>").alias("ids"),
            "lengths",
        ).join(broadcast_if_small(programs), "group")
        arriving = postings.filter(F.col("stage") == s).unionByName(shards, allowMissingColumns=True)
        bundles = store_table(_owner_stage(bundles, arriving, n, length, k, last))

    by_score = Window.partitionBy("group", "slot").orderBy(
        F.desc("score"), F.col("doc_id").asc_nulls_last()
    )
    best = bundles.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    names = broadcast_if_small(asked.select("group", "slot", "item_id"))
    return best.join(names, ["group", "slot"]).select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )


#: The same rows from DuckDB.
SEARCH_SQL = r"""
WITH cut AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
asked AS (
    SELECT row_number() OVER () AS item, item_id,
           unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
    FROM benchmark),
totals AS (
    SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms
    FROM cut WHERE len(terms) > 0),
held AS (
    SELECT row, term, count(*) AS tf
    FROM (SELECT row, unnest(terms) AS term FROM cut)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))
                      AS BIGINT) AS w
    FROM held, totals GROUP BY term, n_docs),
scored AS (
    SELECT a.item, a.item_id, c.row, c.doc_id, CAST(sum(w.w * ((1000000000 * h.tf) //
               (1000 * h.tf + 20 * (50 + (50 * len(c.terms) * t.n_docs) // t.n_terms)))) AS BIGINT)
               AS score
    FROM asked a JOIN held h ON a.term = h.term JOIN weights w ON a.term = w.term
    JOIN cut c ON h.row = c.row, totals t
    GROUP BY ALL),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)
                   AS INTEGER) AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
