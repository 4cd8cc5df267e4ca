"""Rules against plain regular expressions; the bootstrap on planted contexts."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gateflow.llm.pii import bootstrap, find_personal_data, pii_report, redact, rule_spans

SCHEMA = "doc_id long, text string, base string, row long, n_chars long"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [
        (kind, m.start(), m.end()) for kind, rule, ok in rules for m in re.finditer(rule, text) if ok(m.group())
    ]


PIECES = st.sampled_from(["a", "@", ".", "-", "+", "1", "255", "256", "0", " ", "(", ")", "b.c", "4111 1111 1111 1111", "é", "１", "\n", "x@y.z", "10.0.0.1", "+49 (30) 123-456"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_rules_are_the_patterns(text):
    assert rule_spans(text) == plain(text)


def test_long_runs_are_quick():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a.b-" * 80_000, "@" * 200_000, "+1 " * 100_000, "1 - " * 90_000):
        rule_spans(text)
        from gateflow.llm.pii import candidate_spans

        candidate_spans(text, [])


def planted():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(60):
        number = "".join(rng.choice("0123456789") for _ in range(9))
        form = [f"+1 {number}", f"+44 {number}", f"0{number}"][i % 3]
        rows.append((i, f"{word()} {word()} call me at {form} or write {word()}", "b", 1, 0))
    for i in range(60, 90):
        number = "".join(rng.choice("0123456789") for _ in range(9))
        rows.append((i, f"{word()} {word()} {word()} 0{number} {word()}", "b", 1, 0))
    return rows


def test_contexts_of_seeds_find_other_forms(spark):
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(planted(), SCHEMA)).collect()}
    for i, text, *_ in planted():
        assert [tuple(s) for s in got[i].base] == plain(text)
        spans = [tuple(s) for s in got[i].spans]
        if i < 60:
            assert len(spans) == 1 and spans[0][0] == "phone"
            assert len(re.sub(r"\D", "", text[spans[0][1] : spans[0][2]])) >= 9
        else:
            assert spans == []


def test_scores_of_a_small_graph(spark):
    seeds = [("phone", f"s{i}", "p", True) for i in range(4)] + [("phone", "s0", "q", True)]
    others = [("phone", "x", "p", False), ("phone", "y", "q", False), ("phone", "x", "p", False)]
    edges = spark.createDataFrame(seeds + others, "kind string, value string, pattern string, seed boolean")
    one = {r.value: r.score for r in bootstrap(edges, 1, 3).collect()}
    assert set(one) == {"x"} and abs(one["x"] - 4 / 6) < 1e-9
    two = {r.value: r.score for r in bootstrap(edges, 2, 3).collect()}
    assert abs(two["x"] - (4 + 4 / 6) / 6) < 1e-9


GRAPH = "kind string, value string, pattern string, seed boolean"


def plain_limit(edges, least=3, threshold=0.6):
    """Plain rounds, thousands of them; useful patterns by what others say."""
    held = {}
    for _, value, pattern, seed in edges:
        held.setdefault(pattern, {})[value] = seed
    trust = {p: 0.0 for p in held}
    open_ = {v for d in held.values() for v, seed in d.items() if not seed}

    def score(value, but=None):
        doubt = 1.0
        for p, d in held.items():
            if p != but and value in d and not d[value]:
                doubt *= 1 - trust[p]
        return 1 - doubt

    for _ in range(5000):
        new = {}
        for p, d in held.items():
            good = sum(seed or score(v, p) >= threshold for v, seed in d.items())
            total = sum(1.0 if seed else score(v) for v, seed in d.items())
            new[p] = total / (len(d) + 1) if good >= least else 0.0
        if max(abs(new[p] - trust[p]) for p in held) < 1e-12:
            break
        trust = new
    return {v: score(v) for v in open_ if score(v) > 0}


def test_scores_are_the_limit_of_the_rounds(spark):
    edges = [("phone", f"s{i}", "p", True) for i in range(4)] + [("phone", f"x{i}", "p", False) for i in range(12)]
    edges += [("phone", f"s{i}", "q", True) for i in range(3)] + [("phone", f"x{i}", "q", False) for i in range(3)]
    # Three values that p and q accept bring r to life, and its own three bring in t.
    edges += [("phone", f"x{i}", "r", False) for i in range(9, 12)] + [("phone", f"y{i}", "r", False) for i in range(3)]
    edges += [("phone", f"y{i}", "t", False) for i in range(3)] + [("phone", "z", "t", False)]
    edges += [("phone", "s0", "u", True), ("phone", "w", "u", False), ("phone", "w", "v", False)]
    got = {r.value: r.score for r in bootstrap(spark.createDataFrame(edges, GRAPH), epsilon=1e-7).collect()}
    want = plain_limit(edges)
    assert set(got) == set(want) and "z" in got and "w" not in got
    assert all(abs(got[v] - want[v]) < 1e-3 for v in want)


def test_a_common_form_is_found_in_a_hot_context(spark):
    rows = [(i, f"please call me at +1 {200000000 + 7 * i} or write", "b", 1, 0) for i in range(10)]
    rows += [(i, f"please call me at 0{300000000 + 7 * i} or write", "b", 1, 0) for i in range(10, 1010)]
    got = find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [len(r.spans) for r in got] == [1] * 1010


def test_all_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pii_report(docs).collect()
    assert len(got) == len(texts)
    import hashlib

    for r in got:
        base = plain(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)
        assert set(listed.split(",")) <= set(r.spans.split(","))


def test_redacted_texts(spark):
    rows = [(1, "mail a@b.co or 10.0.0.1 now", "x", 5, 27), (1, None, "y", 6, None), (None, "😀 +49 30 1234567", None, 7, 16), (2, "clean", "z", 8, 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = redact(docs)
    assert out.columns == docs.columns
    got = {r.row: (r.text, r.n_chars) for r in out.collect()}
    assert got == {5: ("mail <email> or <ip> now", 24), 6: (None, None), 7: ("😀 <phone>", 9), 8: ("clean", 5)}


def test_empty_table(spark):
    assert pii_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert redact(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_values_and_contexts_stay_apart():
    from gateflow.llm.pii import _patterns, _whole

    long = "x" * 500
    assert _whole(long + "a", 200) != _whole(long + "b", 200)
    assert len(_whole(long, 200)) < 200 and _whole("short", 200) == "short"
    one, two = (f"{'y' * 39}{c}{'z' * 39} w 5" for c in "ab")
    assert _patterns(one, "ip", len(one) - 1, len(one)) != _patterns(two, "ip", len(two) - 1, len(two))
