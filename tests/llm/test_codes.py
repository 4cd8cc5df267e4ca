"""Vector codes against plain Lloyd rounds over all pairs."""

import hashlib
import math
import random

import numpy as np
import pytest

from gateflow.llm.codes import (
    BASE,
    LEAF,
    assign,
    assigned_sums,
    cover_tree,
    squared_distances,
    vector_codes,
)

SCHEMA = "vec_id long, embedding array<double>, label int, code int, error string, part int"


def plain(rows, scale=1024, entries=256, rounds=4):
    """By definition, in Python's integers."""
    sound = [
        (i, label, [math.floor(scale * x) for x in v])
        for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not sound:
        return []
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(sound[0][2]) // 4
    cut = [[v[p * width : (p + 1) * width] for p in range(4)] for _, _, v in sound]
    books = [[list(parts[p]) for parts in cut[:entries]] for p in range(4)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(parts[p], p)[1] for parts in cut] for p in range(4)]
        for p in range(4):
            for k in range(len(books[p])):
                members = [parts[p] for parts, e in zip(cut, found[p]) if e == k]
                if members:
                    books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    final = [[nearest(parts[p], p) for p in range(4)] for parts in cut]
    errors = [sum(d for d, _ in f) for f in final]
    by_label = {}
    for (_, label, _), error in zip(sound, errors):
        by_label[label] = by_label.get(label, 0) + error
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in f), error, by_label[label], sha)
         for (i, label, _), f, error in zip(sound, final, errors)),
        key=repr,
    )


def check(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, 1, "e", 2) for r in rows], SCHEMA)
    block_rows = settings.pop("block_rows", 4096)
    got = vector_codes(frame, block_rows=block_rows, **settings).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, **settings)
    return got


def cloud(n, dim, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dim))
    return (1024 * (centres[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, dim)))).astype(np.int64)


def test_trees_cover_and_separate():
    points = np.unique(np.vstack([cloud(900, 5, 1), cloud(50, 5, 2, 3.0)]), axis=0)
    order, nodes = cover_tree(points)
    assert sorted(order.tolist()) == list(range(len(points)))
    placed = points[order].astype(float)
    for node in nodes:
        inside = placed[node["begin"] : node["end"]]
        away = np.sqrt(((inside - placed[node["centre"]]) ** 2).sum(axis=1))
        assert math.isclose(away.max(), node["radius"], abs_tol=1e-9)
        children = nodes[node["child"] : node["last"]]
        if len(children):
            assert children["begin"][0] == node["begin"] and children["end"][-1] == node["end"]
            assert (children["begin"][1:] == children["end"][:-1]).all()
            scale = node["radius"] / BASE
            assert (children["radius"] <= scale + 1e-9).all()
            centres = placed[children["centre"]]
            gaps = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2))
            assert (gaps[~np.eye(len(gaps), dtype=bool)] > scale).all()
        else:
            assert node["end"] - node["begin"] <= LEAF


@pytest.mark.parametrize("dim,spread", [(2, 0.02), (16, 0.05), (16, 1.0)])
def test_trees_assign_as_all_pairs_do(dim, spread):
    points = np.unique(cloud(3000, dim, 3, spread), axis=0)
    order, nodes = cover_tree(points)
    placed = points[order]
    rng = np.random.default_rng(4)
    entries = placed[rng.integers(0, len(placed), 64)]
    entries = np.vstack([entries, entries[:8], np.full((1, dim), 10**6)])
    nearest, compared = assign(placed, nodes, entries)
    assert (nearest == squared_distances(placed, entries).argmin(axis=1)).all()
    assert compared <= len(placed)
    weights = rng.integers(1, 5, len(placed))
    sums, counts = assigned_sums(placed, weights, nearest, len(entries))
    for k in range(len(entries)):
        mine = nearest == k
        assert counts[k] == weights[mine].sum()
        assert (sums[k] == (placed[mine] * weights[mine, None]).sum(axis=0)).all()


def test_whole_subtrees_go_to_separate_entries():
    points = np.unique(cloud(3000, 16, 5, 0.02), axis=0)
    order, nodes = cover_tree(points)
    centres = np.random.default_rng(5).normal(0, 1, (12, 16))
    entries = (1024 * centres).astype(np.int64)
    nearest, compared = assign(points[order], nodes, entries)
    assert (nearest == squared_distances(points[order], entries).argmin(axis=1)).all()
    assert compared == 0


def test_ties_go_to_the_lower_index():
    points = np.arange(-30, 31)[:, None] * 2
    order, nodes = cover_tree(points)
    entries = np.array([[5], [1], [-3], [1], [9]])
    nearest, _ = assign(points[order], nodes, entries)
    expected = [min(range(5), key=lambda k: ((p - entries[k, 0]) ** 2, k)) for p in points[order][:, 0]]
    assert nearest.tolist() == expected


def test_distances_of_large_integers_are_exact():
    points = np.array([[2**29, -(2**29)], [2**29 + 1, 3]])
    entries = np.array([[2**29, -(2**29) + 1], [0, 0]])
    expected = [[sum((a - b) ** 2 for a, b in zip(p, e)) for e in entries.tolist()] for p in points.tolist()]
    assert squared_distances(points, entries).tolist() == expected


def vectors(n, dim, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    out = []
    for i in rng.sample(range(-n, n), n):
        centre = rng.choice(centres)
        out.append((i, [x + rng.gauss(0, 0.2) for x in centre], rng.choice([None, 0, 1, 2])))
    return out


def test_codes_match_the_plain_rounds(spark):
    rows = vectors(400, 8, 5)
    check(spark, rows, entries=20)
    check(spark, rows, entries=20, block_rows=37)
    check(spark, rows[:300], rounds=1)
    check(spark, rows[:60], entries=9, rounds=0, scale=7)


def test_unusable_repeated_and_few_rows(spark):
    rows = vectors(30, 4, 6)
    rows += [(7, [0.5, 0.25, -0.125, 1e-9], 1)] * 60 + [(8, [0.5, 0.25, -0.125, 1e-9], None)] * 9
    rows += [(None, [0.1, 0.2, 0.3, 0.4], 3), (None, [-0.1, 0.2, 0.3, 0.4], None)]
    rows += [(90, None, 1), (91, [None, 1.0, 1.0, 1.0], 1), (92, [float("nan")] * 4, 1)]
    rows += [(93, [float("inf"), 0.0, 0.0, 0.0], 1), (94, [], 1)]
    got = check(spark, rows)
    assert len(got) == 30 + 69 + 2
    check(spark, rows, entries=40, block_rows=16)
    check(spark, [(3, [0.1, -0.1, 0.0, 5.0], None)])
    assert check(spark, []) == []
    assert check(spark, [(1, None, 1)]) == []


def test_lengths_and_sizes_that_cannot_be_coded(spark):
    def run(rows):
        frame = spark.createDataFrame([(*r, 1, "e", 2) for r in rows], SCHEMA)
        return vector_codes(frame).count()

    with pytest.raises(Exception, match="different lengths"):
        run([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)])
    with pytest.raises(Exception, match="cannot be cut"):
        run([(1, [1.0] * 6, 1)])
    with pytest.raises(Exception, match="too large"):
        run([(1, [1e30] * 4, 1)])
