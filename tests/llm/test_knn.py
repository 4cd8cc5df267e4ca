"""Exact neighbours against the plain product of all pairs."""

import math
import random

from gateflow.llm.knn import knn_join

SCHEMA = "vec_id long, embedding array<double>, score string"


def plain(rows, every, k):
    sound = [
        (n, i, [math.floor(256 * x) for x in v])
        for n, (i, v, *_) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, q in sound:
        if i % every == 0:
            found = [(-sum(a * b for a, b in zip(q, v)), j) for m, j, v in sound if m != n and len(v) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def check(spark, rows, **settings):
    got = knn_join(spark.createDataFrame(rows, SCHEMA), **settings).collect()
    assert sorted(map(tuple, got)) == plain(rows, settings.get("every", 50), settings.get("k", 5))


def clustered(n, dim, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], "s") for i in range(n)]


def test_clusters_with_small_blocks(spark):
    check(spark, clustered(300, 8, 1), every=7, block_rows=20, block_queries=3)


def test_ties_repeats_and_unusable_vectors(spark):
    rows = [(i, [0.5, -0.25], "s") for i in range(40)] + [(10, [0.5, -0.25], "s"), (0, [1.0, 1.0], "t")]
    rows += [(50, None, ""), (60, [None, 1.0], ""), (70, [float("nan"), 0.0], ""), (80, [float("inf"), 0.0], "")]
    rows += [(None, [1.0, 1.0], ""), (90, [1.0], ""), (91, [2.0], ""), (100, [], ""), (-10, [0.0, 3.0], "")]
    check(spark, rows, every=10, k=5)


def test_few_candidates_and_empty_table(spark):
    check(spark, [(0, [1.0], "")], every=1)
    check(spark, [(0, [1.0], ""), (1, [-1.0], "")], every=1)
    assert knn_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**22 + i), float(2**21 - 3 * i)], "") for i in range(12)]
    check(spark, rows, every=3)
