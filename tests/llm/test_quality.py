"""Passage features, the gradient of the model, and held-out accuracy."""

import numpy as np
import pytest

from gateflow.llm import quality as q

SCHEMA = "doc_id long, text string, quality string, score long"


def test_features_of_passages():
    assert q.passages("").shape == (1, q.N_FEATURES) and not q.passages("").any()
    assert not q.passages(" \n ").any()
    rows = q.passages(" ".join(["ab"] * 130))
    assert rows.shape[0] == 3
    assert np.allclose(rows[:, : q._N_CLASSES].sum(axis=1), 1)
    assert np.allclose(rows[0, q._N_CLASSES + 2], 63 / 64)  # equal to the word before
    assert np.allclose(rows[:, q._N_CLASSES + 4], [1 / 64, 1 / 64, 1 / 2])  # distinct
    assert np.allclose(rows[:, q._N_CLASSES + 5], [1, 1, 2 / 64])
    lead = q.passages("  \n ab cd ab é")
    assert np.allclose(lead[0, q._N_CLASSES + 3], 1 / 4)


def test_long_texts_go_in_pieces(monkeypatch):
    text = "Some words, and some more of them. " * 4000
    whole = q.passages(text)
    monkeypatch.setattr(q, "_PIECE", 40_000)
    pieces = q.passages(text)
    assert abs(len(pieces) - len(whole)) < 20
    assert np.allclose(pieces.mean(axis=0), whole.mean(axis=0), atol=0.02)
    assert len(q.passages("x" * 50_000)) == 2


def test_training_follows_the_gradient():
    rng = np.random.default_rng(1)
    bags = [rng.random((rng.integers(1, 5), q.N_FEATURES)) for _ in range(20)]
    labels = rng.integers(0, 2, 20).astype(float)
    weights = np.full(20, 1 / 20)
    model = q.AttentionModel()
    x = np.vstack(bags)
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])

    def loss():
        y = model._forward(x, starts)["y"]
        return -(weights * (labels * np.log(y) + (1 - labels) * np.log(1 - y))).sum()

    grads = model.gradients(x, starts, labels, weights)
    for name, g in grads.items():
        flat = model.p[name].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            kept = flat[i]
            flat[i] = kept + 1e-5
            up = loss()
            flat[i] = kept - 1e-5
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-6, name


def test_attention_finds_the_one_bad_passage():
    rng = np.random.default_rng(2)
    bags, labels = [], []
    for i in range(200):
        bag = rng.random((8, q.N_FEATURES)) * 0.1
        if i % 2:
            bag[rng.integers(8), 3] = 1.0
        bags.append(bag)
        labels.append(float(i % 2 == 0))
    model = q.AttentionModel().fit(bags[:100], np.array(labels[:100]), np.ones(100))
    scores = model.scores(bags[100:])
    assert ((scores >= 0.5) == (np.array(labels[100:]) == 1)).mean() > 0.95


def test_report_and_filter_on_odd_rows(spark):
    good = "The cat sat on the mat and looked out. " * 6
    bad = "CAT!! SAT### MAT*** LOOK%%% " * 9
    rows = [(i, (good, bad)[i % 2] + str(i), "q", 1) for i in range(120)]
    rows += [(None, None, None, 1), (3, good, "x", 2), (3, good, "x", 2), (500, "", "x", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(
        [(i, 1 - i % 2, 0) for i in range(120)] + [(None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int"
    )
    got = q.quality_report(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id != 3)
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 120 and r.doc_id != 3]
    assert sorted(ids) == list(range(0, 120, 2))


@pytest.mark.parametrize("empty", ["docs", "labels"])
def test_empty_tables(spark, empty):
    docs = spark.createDataFrame([] if empty == "docs" else [(1, "a", "", 1)], SCHEMA)
    labels = spark.createDataFrame([] if empty == "labels" else [(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert q.quality_report(docs, labels).count() == (0 if empty == "docs" else 1)
    assert q.keep_good(docs, labels).count() <= 1


def test_held_out_rows_of_the_given_table(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.quality_report(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    low = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    assert sum(r.predicted == 0 for r in low) / len(low) > 0.9
