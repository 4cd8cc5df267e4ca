"""The automaton against plain edit distance; held-out accuracy."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gateflow.llm.toxicity import FEATURES, Trie, fit_logistic, text_features, toxicity_report

TERMS = [("idiot", False), ("scum", False), ("lowei", True), ("dastol", True), ("worthless", False), ("veju", True), ("fu", False)]


def distance(a, b):
    """Edits between two words; a swap of neighbours, left alone after it, is one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def plain(word):
    """Fewest edits to a term, or to a beginning of the word for a stem."""
    best = None
    for term, stem in TERMS:
        allowed = 0 if len(term) < 4 else 1 if len(term) < 9 else 2
        if stem:
            allowed = 0
        forms = [word[:k] for k in range(len(word))] if stem else [word]
        n = min((distance(form, term) for form in forms), default=99)
        if n <= allowed and (best is None or n < best):
            best = n
    return best


@settings(max_examples=1500, deadline=None)
@given(st.sampled_from([t for t, _ in TERMS]), st.lists(st.tuples(st.sampled_from("idst"), st.integers(0, 11), st.sampled_from("aeilostvw0")), max_size=3), st.text("aei", max_size=3))
def test_automaton_is_the_edit_distance(word, edits, tail):
    for kind, at, letter in edits:
        at = min(at, len(word))
        if kind == "t":
            word = word[:at] + word[at : at + 2][::-1] + word[at + 2 :]
            continue
        word = word[:at] + ("" if kind == "d" else letter) + word[at + (kind != "i") :]
    word += tail
    found = Trie(TERMS).find(word)
    assert (found and found[1]) == plain(word)


@pytest.mark.parametrize(
    "word", ["ldiot", "1diot", "idoit", "mroon", "stupdi", "scumm", "id*ot", "s.t.u.p.i.d", "worhtlses", "$cum"]
)
def test_misspellings_are_found(word):
    trie = Trie([(t, False) for t in ("idiot", "moron", "stupid", "scum", "worthless")])
    got = dict(zip(FEATURES, text_features(f"so there you {word} go", trie, {})))
    assert got["any_abuse"] and got["any_misspelt"] and got["log_second_person"]


def test_words_of_their_own_are_no_misspellings():
    trie = Trie([("scum", False)], frozenset({"sum"}))
    assert trie.find("sum") is None and trie.find("scm") == ("scum", 1) and trie.find("scum") == ("scum", 0)
    assert text_features("one/two, a.b.c and x|y|z at www.some.org", trie, {}) == [0.0] * len(FEATURES)
    assert text_features("x" * 200_000 + " " + "a." * 50_000, trie, {}) == [0.0] * len(FEATURES)


def test_windows_tell_quotation_from_abuse():
    trie = Trie(TERMS)
    abuse = dict(zip(FEATURES, text_features("you are an idiot and an idoit or idiott", trie, {})))
    assert abuse["any_abuse"] and abuse["any_misspelt"] and not abuse["any_quoted"] and abuse["log_second_person"]
    quoted = dict(zip(FEATURES, text_features('the word "idiot" is said to be old', trie, {})))
    assert quoted["any_quoted"] and not quoted["any_abuse"]
    assert text_features("", trie, {}) == [0.0] * len(FEATURES)


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 2))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    w = fit_logistic(x, y, penalty=0.0)
    assert abs(w[0] - 2) < 0.3 and abs(w[1]) < 0.2 and abs(w[2] + 1) < 0.2
    assert (fit_logistic(np.zeros((0, 2)), np.zeros(0)) == 0).all()


def synthetic(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                text[rng.randrange(40)] = rng.choice(["zonkers", "zonkres", "quibtard" + rng.choice("aeiou") * 2])
        docs.append((i, " ".join(text), "l", 1))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs += [(None, None, "l", 1), (5, "", "l", 1), (5, "zonkers zonkers", "l", 1)]
    labels += [(None, 1, 1), (4, None, None), (10, 1, 1), (10, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, toxic string, score int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_learnt_terms_catch_all_forms(spark):
    docs, labels = synthetic(spark)
    got = toxicity_report(docs, labels).collect()
    assert len(got) == 603
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None and r.doc_id != 5:
            assert r.predicted == int(r.doc_id % 5 == 0)
    assert all(r.predicted == 0 for r in got if r.doc_id is None)


@pytest.mark.parametrize("empty", ["docs", "labels", "both"])
def test_empty_tables(spark, empty):
    docs, labels = synthetic(spark)
    docs = docs.limit(0) if empty != "labels" else docs
    labels = labels.limit(0) if empty != "docs" else labels
    rows = toxicity_report(docs, labels).collect()
    assert len(rows) == (603 if empty == "labels" else 0)
    assert all(r.score == 0.5 for r in rows)


def test_held_out_rows_of_the_given_table(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity_report(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    caught = sum(r.predicted for r in rows if r.toxic)
    assert right / len(rows) > 0.98
    # Some toxic rows are junk without a term, which nothing in the text betrays.
    assert caught / sum(r.toxic for r in rows) > 0.85


def test_a_term_quoted_in_many_other_texts_stays(spark):
    from gateflow.llm.toxicity import learn_lexicon

    rows = [(f"some{i} plain{i % 7} words then w{i} zorkface again", 1) for i in range(150)]
    rows += [(f"they{i} quote{i % 9} and w{i} zorkface too", 0) for i in range(60)]
    rows += [(f"clean{i} text{i % 11} about w{i} weather and copied", 0) for i in range(3000)]
    # One text in many copies is one text, for either label.
    rows += [("a single copied1 text zorkface", 0)] * 400
    terms, _ = learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert ("zorkface", False) in terms
    assert not {"weather", "copied", "text", "single"} & {t for t, _ in terms}


def test_a_word_of_one_long_text_is_no_term(spark):
    from gateflow.llm.toxicity import learn_lexicon

    rows = [(f"some{i} plain{i % 7} words w{i} zorkface again", 1) for i in range(200)]
    rows += [(" ".join(f"near{i} oncehere" for i in range(500)), 1)]
    rows += [(f"clean{i} text{i % 11} about w{i} and forkface", 0) for i in range(2000)]
    # So is one of a text in many near copies.
    body = " ".join(f"then{i} copyword" for i in range(60))
    rows += [(f"copy number{i} of {body}", 1) for i in range(60)]
    terms, none = learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    held = {t for t, _ in terms}
    assert "zorkface" in held and not {"oncehere", "copyword"} & held
    # One edit from a term, but a word of the other texts.
    assert "forkface" in none


def test_every_family_has_its_stem_however_many(spark):
    from gateflow.llm.toxicity import learn_lexicon

    rng = random.Random(9)
    names = ["".join(rng.choice("bcdfghjk") for _ in range(7)) for _ in range(60)]
    rows = []
    for i in range(1200):
        own = names[i % 60]
        rows.append((f"pre{i} {own}{i} mid{i}", 1))
    rows += [(f"clean{i} text{i % 13} words{i}", 0) for i in range(12000)]
    terms, _ = learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    for name in names:
        assert sum(name.startswith(t) and stem for t, stem in terms) == 1
    # No member of a family is kept beside its stem.
    stems = {t for t, stem in terms if stem}
    assert not any(t[:k] in stems for t, stem in terms for k in range(4, len(t)))
