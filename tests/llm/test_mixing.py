"""Targets and takings against plain computations."""

import re
from collections import defaultdict

import pytest

from gateflow.llm.mixing import mix_sources, mixed_documents, mixing_report

SCHEMA = "doc_id long, text string, source string, size long, n_chars long"


def plain_targets(sizes):
    """Shares by weight, excess above three times a source handed on by rounds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return target


def rows():
    out = []
    for i in range(400):
        source = ["a", "b", "c", "é", None, "z"][i % 6] if i % 3 else "hot"
        out.append((i, "w " * ((i * 37) % 90 + (400 if i % 50 == 0 else 0)), source))
    out += [(500, None, "a"), (501, "", "only empty"), (502, "x y z", "single"), (503, " x ", "tiny")]
    out += [(700, "a b", "a"), (700, "a b", "a"), (None, "q r s", "b")]
    return [(i, t, s, 1, len(t or "")) for i, t, s in out]


def test_targets_and_takings(spark):
    data = rows()
    got = mix_sources(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    sizes, source = defaultdict(int), {}
    for i, t, s, *_ in data:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        source[i] = s
    target = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(target[s], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1, s


def test_rates_tilt_with_size(spark):
    """Above one where a source grows and below it where it shrinks."""
    data = [(i, "w " * (i % 40 + 1), "big" if i % 4 else "small", 0, 0) for i in range(4000)]
    got = mix_sources(spark.createDataFrame(data, SCHEMA)).collect()
    for source_is_big, low_above in ((True, False), (False, False)):
        own = [r for r in got if (r.doc_id % 4 != 0) == source_is_big]
        ratio = lambda lo, hi: sum(r.taken for r in own if lo <= r.size < hi) / sum(r.size for r in own if lo <= r.size < hi)
        grows = own[0].target > own[0].source_size
        assert (ratio(30, 41) > ratio(1, 11)) == grows


def test_reruns_and_partitions_agree(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).filter("doc_id <> 700")
    one = sorted(map(tuple, mixing_report(docs).collect()), key=str)
    two = sorted(map(tuple, mixing_report(docs.repartition(13)).collect()), key=str)
    assert one == two


def test_documents_are_repeated_and_cut(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        if r.doc_id is not None:  # the join below cannot see it
            words[r.source] += len((r.text or "").split())
        assert r.n_chars == len(r.text)
    want = defaultdict(float)
    for r in mix_sources(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect():
        want[r.source] += r.taken
    for s, n in want.items():
        assert words[s] == n


def test_empty_table(spark):
    assert mixing_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixed_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
