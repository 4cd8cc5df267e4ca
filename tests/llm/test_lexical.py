"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest

from gateflow.llm import lexical
from gateflow.llm.lexical import ranked_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item_id string, term int, score double, slot string"
ITEMS = "item_id long, text string, doc_id string, rank int"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """By definition; items and documents by row."""
    found = [(i, terms(text)) for i, text in docs]
    held = [(i, Counter(t), len(t)) for i, t in found if t]
    n, length = len(held), sum(size for _, _, size in held)
    df = Counter(term for _, counts, _ in held for term in counts)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, counts, size in held:
            m = 100 - 50 + (50 * size * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 20 * m))
                for t in set(terms(text))
                if t in counts
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=repr)


def check(spark, docs, items, k=50, **settings):
    frames = (
        spark.createDataFrame([(i, t, "x", 3, 0.5, "y") for i, t in docs], DOCS),
        spark.createDataFrame([(i, t, "z", 9) for i, t in items], ITEMS),
    )
    got = sorted(map(tuple, ranked_search(*frames, k=k, **settings).collect()), key=repr)
    assert got == plain(docs, items, k)
    return got


def corpus(n, seed):
    """Words by a long-tailed law, so that some are in most texts and some in one."""
    rng = random.Random(seed)
    words = [f"w{i}" if i % 5 else f"Wé{i}" for i in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    docs = [(i, ", ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 30)))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize(
    "settings",
    [{}, {"shard_docs": 16, "k": 5}, {"term_bytes": 0, "shard_docs": 50, "stages": 2}, {"group_items": 3, "stages": 1}],
)
def test_search_matches_plain_scoring(spark, settings):
    docs, items = corpus(300, 1)
    check(spark, docs, items, **settings)


def test_terms_are_those_of_the_pattern():
    texts = ["", "A-b_c9Z", "É É1 ǅ x y", "\x00a\x7fb{c}~d", "𝒳,字字 ЯЖ", "a" * 50_000]
    for text in texts:
        assert [t.decode() for t in terms_of(text.encode())] == terms(text)
    assert terms_of(None) == []


def test_missing_empty_repeated_and_tied_rows(spark):
    docs = [(i % 40, "the same text of many rows") for i in range(500)]
    docs += [(None, "the same text of many rows"), (None, "rare"), (90, None), (91, ""), (92, "--")]
    docs += [(93, "rare " + "filler " * 30_000), (94, "RARE many"), (95, "other words here")]
    items = [(1, "many rows"), (1, "many rows"), (2, None), (3, "unknown"), (None, "rare"), (4, ""), (5, "the rare other")]
    got = check(spark, docs, items, k=7, shard_docs=32)
    assert len([r for r in got if r[0] == 1]) == 14


def test_term_of_all_documents_counts_nothing(spark):
    docs = [(i, "common") for i in range(2000)]
    assert check(spark, docs, [(1, "common")]) == []


def test_empty_tables(spark):
    docs, items = corpus(5, 2)
    for some in (([], items), (docs, []), ([], []), ([(1, None)], items), (docs, [(1, None)])):
        assert check(spark, *some) == []


def test_bundles_drop_what_cannot_win(spark, monkeypatch):
    docs, items = corpus(3000, 3)
    sizes = []
    stored = lexical.store_table

    def watched(df):
        out = stored(df)
        if "scores" in out.columns:
            sizes.append(out.selectExpr("coalesce(sum(length(docs) div 2), 0)").first()[0])
        return out

    monkeypatch.setattr(lexical, "store_table", watched)
    check(spark, docs, items, k=5, shard_docs=200)
    pairs = sum(bool(set(terms(a)) & set(terms(b))) for _, a in docs for _, b in items)
    assert len(sizes) == 4 and max(sizes) < pairs / 2
