"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Among all rates of its documents that meet the
target and stay within the cap, those nearest to "take each once" in relative entropy
are exponential tilts of the size: min(cap, exp(lambda * size / mean size)). The dual of a source is one number,
found by Newton steps; every step is one distributed sum over strata (source, size,
count), which are all that the sums need, so documents are read once. Rates become
whole copies by systematic rounding along the sizes; what the rounding leaves of a
target is taken from one document of the source, whose last copy is cut.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateflow.llm.tables import WORD
from gateflow.operators.joins import broadcast_if_small
from gateflow.session import store_table


def document_sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, source and size (words; a missing text has none) of every row."""
    return docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(strata: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sid, source, source_size and target of every source.

    Sources in order of code points, missing last, take the weights by turns and share
    all words by them; no target exceeds ``cap`` times its source. The excess goes to
    the others by weight: with sources in order of cap / weight, one share per unit of
    weight serves all that are not held by their cap. One row a source is sorted here.
    """
    sums = strata.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    listed = ", ".join(f"{float(w)}D" for w in weights)
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    ranked = sums.withColumn("sid", place).withColumn(
        "weight", F.expr(f"element_at(array({listed}), (sid - 1) % {len(weights)} + 1)")
    )
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    shared = ranked.withColumn(
        "share",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / F.sum("weight").over(rest),
    )
    free = F.when(F.col("most") > F.col("share") * F.col("weight"), F.col("share"))
    level = shared.withColumn("level", F.max(free).over(everything))
    return level.select(
        "sid",
        "source",
        "source_size",
        F.when(F.col("level").isNull(), F.col("most"))
        .otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
        .alias("target"),
    )


def entropy_balance(
    strata: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-10, rounds: int = 60
) -> DataFrame:
    """sid and lambda of every source, by Newton steps on the log of the sum.

    The bracket of each source shrinks with every step; a step that leaves it is
    replaced by its middle, so the search ends for any sizes. ``strata`` has sid, x
    (size over the mean size of the source), words (size times count).
    """
    start = strata.filter("words > 0").groupBy("sid").agg(
        F.min("x").alias("least_x"), F.sum("words").alias("all_words")
    )
    state = store_table(
        sources.filter(f"target > 0 AND target < {cap} * source_size").join(start, "sid").select(
            "sid",
            "target",
            F.lit(0.0).alias("lam"),
            F.expr("least(0D, ln(greatest(target, 1e-9) / all_words) / least_x)").alias("low"),
            F.expr(f"ln({float(cap)}D) / least_x").alias("high"),
            F.lit(False).alias("done"),
        )
    )
    for _ in range(rounds):
        rate = F.expr(f"least({float(cap)}D, exp(lam * x))")
        sums = (
            strata.filter("words > 0")
            .join(state.filter("NOT done"), "sid")
            .withColumn("rate", rate)
            .groupBy("sid")
            .agg(
                F.sum(F.col("words") * F.col("rate")).alias("f"),
                F.sum(
                    F.when(F.col("rate") < cap, F.col("words") * F.col("rate") * F.col("x")).otherwise(0.0)
                ).alias("slope"),
            )
        )
        moved = (
            state.join(sums, "sid", "left")
            .withColumn("near", F.expr(f"done OR abs(f - target) <= {tolerance}D * target OR high - low < 1e-15"))
            .withColumn("low", F.expr("IF(NOT near AND f < target, lam, low)"))
            .withColumn("high", F.expr("IF(NOT near AND f >= target, lam, high)"))
            .withColumn("step", F.expr("lam + ln(target / f) * f / nullif(slope, 0)"))
            .withColumn(
                "next",
                F.expr("IF(step IS NULL OR isnan(step) OR step <= low OR step >= high, (low + high) / 2, step)"),
            )
        )
        state = store_table(
            moved.select(
                "sid",
                "target",
                F.expr("IF(near, lam, next)").alias("lam"),
                "low",
                "high",
                F.col("near").alias("done"),
            )
        )
        if state.filter("NOT done").isEmpty():
            break
    # Sums of doubles may differ in their last places from run to run.
    return state.select("sid", F.round("lam", 9).alias("lam"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: int = 3,
    bucket_rows: int = 4096,
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row, and its copies.

    ``copies`` whole copies and ``part`` words of one more (negative: words cut from
    the last copy) are ``taken`` words; it never exceeds ``cap`` times the size. A
    missing text has size 0 and is taken 0 times; a missing source is one of its own;
    repeated rows are documents of their own; an empty table gives no row. Reruns
    agree, as ties are broken by hashes of doc_id alone.
    """
    return _mixed(store_table(document_sizes(docs)), weights, cap, bucket_rows)


def _mixed(
    sizes: DataFrame, weights: tuple[float, ...], cap: int, bucket_rows: int = 4096
) -> DataFrame:
    strata = store_table(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = store_table(source_targets(strata, weights, cap))
    means = strata.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")
    )
    named = sources.withColumnRenamed("source", "of").join(
        means.withColumnRenamed("source", "mean_of"), F.expr("of <=> mean_of")
    )
    strata = store_table(
        strata.join(named, F.expr("source <=> of")).select(
            "sid",
            "source",
            "size",
            "n",
            (F.col("size") * F.col("n")).cast("double").alias("words"),
            (F.col("size") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)).alias("x"),
        )
    )
    tilts = entropy_balance(strata, sources, cap)
    full = F.expr(f"target >= {cap} * source_size")
    rated = (
        strata.join(sources.drop("source"), "sid")
        .join(tilts, "sid", "left")
        .withColumn(
            "rate",
            F.when(F.col("size") == 0, 0.0)
            .when(full, float(cap))
            .when(F.col("lam").isNull(), 0.0)
            .otherwise(F.expr(f"least({float(cap)}D, exp(lam * x))")),
        )
        .withColumn("whole", F.floor("rate"))
        .withColumn("over", F.col("rate") - F.col("whole"))
    )
    # Copies beyond the whole ones go to every 1/over-th document along the sizes.
    along = Window.partitionBy("sid").orderBy("size")
    rated = store_table(
        rated.withColumn(
            "above",
            F.coalesce(
                F.sum(F.col("n") * F.col("over")).over(along.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0.0),
            ),
        ).select(
            "sid", "source", "size", "n", "whole", "over", "above", "source_size", "target",
            (F.col("n") / F.lit(bucket_rows) + 1).cast("long").alias("buckets"),
        )
    )
    placed = sizes.withColumnRenamed("source", "s").withColumnRenamed("size", "z").join(
        rated, F.expr("s <=> source AND z = size")
    )
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    # The place of a document in its stratum, without sorting a stratum in one task.
    per_bucket = placed.groupBy("sid", "size", "bucket").agg(F.count("*").alias("held"))
    ahead = F.sum("held").over(
        Window.partitionBy("sid", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    per_bucket = per_bucket.select("sid", "size", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(
        Window.partitionBy("sid", "size", "bucket").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    )
    copied = (
        placed.withColumn("inside", inside)
        .join(per_bucket, ["sid", "size", "bucket"])
        .withColumn("k", F.col("ahead") + F.col("inside"))
        .withColumn(
            "copies",
            F.expr(
                "whole + floor(above + k * over + 0.5D) - floor(above + (k - 1) * over + 0.5D)"
            ).cast("long"),
        )
        .withColumn("copies", F.least("copies", F.lit(cap)))
        .select("row", "doc_id", "sid", "size", "source_size", "target", "copies")
    )
    copied = store_table(copied)
    # One document a source takes what the rounding left, as far as its size allows.
    rests = copied.groupBy("sid").agg(
        F.round(F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("rest"),
        F.max(F.struct((F.col("size") * (cap - F.col("copies"))).alias("room"), -F.col("doc_id"), "row")).alias("up"),
        F.max(F.struct((F.col("size") * F.least("copies", F.lit(1))).alias("room"), -F.col("doc_id"), "row")).alias("down"),
    )
    parts = rests.select(
        F.expr("IF(rest >= 0, up.row, down.row)").alias("part_row"),
        F.expr("IF(rest >= 0, least(rest, up.room), -least(-rest, down.room))").alias("part"),
    ).filter("part <> 0")
    return copied.join(parts, F.col("row") == F.col("part_row"), "left").select(
        "row",
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size") + F.coalesce("part", F.lit(0))).alias("taken"),
    )


def mixing_report(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, the words taken."""
    return mix_sources(docs).drop("row")


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3
) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken.

    A last copy that is not whole ends after its words. All columns stay; ``n_chars``,
    where there is one, counts a cut text anew.
    """
    stored = store_table(docs.withColumn("__key", F.monotonically_increasing_id()))
    sizes = store_table(document_sizes(stored, "__key"))
    taken = _mixed(sizes, weights, cap).select(
        F.col("row").alias("__key"),
        F.col("size").alias("__size"),
        F.col("taken").alias("__taken"),
    )
    lengths = F.expr(
        "transform(sequence(1, CAST(ceil(__taken / __size) AS INT)), "
        "i -> least(__size, __taken - (i - 1) * __size))"
    )
    taken = broadcast_if_small(taken.filter("__taken > 0"))
    copies = stored.join(taken, "__key").withColumn(
        "__length", F.explode(lengths)
    )
    head = F.array_join(
        F.slice(
            F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)),
            F.lit(1),
            F.col("__length").cast("int"),
        ),
        "",
    )
    cut = F.col("__length") < F.col("__size")
    copies = copies.withColumn("text", F.when(cut, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        copies = copies.withColumn(
            "n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return copies.select(*docs.columns)
