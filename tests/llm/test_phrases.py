"""Locally consistent parsing against a plain parse of one text at a time."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gateflow.llm.phrases import (
    Fingerprint,
    Parsing,
    document_fingerprints,
    document_phrases,
    edited_text,
    fingerprint_texts,
    fingerprints_against_next,
    likeness,
    next_level,
    phrases,
)

MASK = (1 << 64) - 1
SCHEMA = "doc_id long, text string, fingerprint int, part string, n_chars string"


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def tossed(names):
    """Labels of one round, by the definition."""
    out = []
    for i, name in enumerate(names):
        differ = name ^ names[i - 1] if i else 1
        low = next(bit for bit in range(64) if differ >> bit & 1)
        out.append(2 * low + (name >> low & 1))
    return out


def plain_level(names):
    """(name, begin) of each phrase of one text."""
    runs = []
    for i, name in enumerate(names):
        if runs and runs[-1][0] == name:
            runs[-1][1] += 1
        else:
            runs.append([name, 1, i])
    power = [n if k == 1 else mixed((n + mixed(k)) & MASK) for n, k, _ in runs]
    labels = power
    for _ in range(4):
        labels = tossed(labels)
    assert all(a != b for a, b in zip(labels, labels[1:])) and max(labels, default=0) < 6
    begins = [
        i
        for i in range(len(labels))
        if i == 0
        or (1 < i < len(labels) - 1 and labels[i] > labels[i - 1] and labels[i] > labels[i + 1])
    ]
    out = []
    for begin, end in zip(begins, begins[1:] + [len(power)]):
        total = sum(p * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, p in enumerate(power[begin:end]))
        out.append((mixed(total & MASK), runs[begin][2]))
    return out


def plain_fingerprint(text, parsing):
    names = [ord(c) for c in text]
    levels = [[mixed(n) for n in names]]
    for _ in range(parsing.levels):
        names = [n for n, _ in plain_level(names)]
        levels.append(names)
    top = max([level for level, x in enumerate(levels) if len(x) >= parsing.least], default=0)
    names = numbered(levels[top])[: parsing.kept]
    return top, names, numbered(levels[top - 1])[: parsing.kept_below] if top else []


def numbered(names):
    """24 bits of every name, later occurrences as names of their own."""
    seen, out = Counter(), set()
    for name in names:
        high, times = name >> 40, seen[name >> 40]
        out.add(mixed(high | times << 32) >> 40 if times else high)
        seen[high] += 1
    return sorted(out)


def prose(rng, n):
    words = ["".join(rng.choices("abcdefgåé字", k=rng.randint(1, 8))) for _ in range(400)]
    return " ".join(rng.choices(words, k=n))


def texts(seed):
    rng = random.Random(seed)
    out = [prose(rng, n) for n in (1, 2, 5, 12, 60, 300, 2000)]
    out += ["", "a", "aa", "ab", "aaaaaaaaaa", "abababababab" * 40, "x" * 5000, "\n\n word", "𝒳𝒴" * 30]
    return out


def test_levels_are_those_of_the_plain_parse():
    for text in texts(1):
        names = [ord(c) for c in text]
        array, first = np.array(names, np.uint64), np.zeros(len(names), bool)
        first[:1] = True
        for _ in range(4):
            expected = plain_level(names)
            array, first, begins = next_level(array, first)
            assert list(zip(array.tolist(), begins.tolist())) == expected
            names = [n for n, _ in expected]


@pytest.mark.parametrize("parsing", [Parsing(), Parsing(4, 3, 5), Parsing(0, 1, 1000, 7)])
def test_fingerprints_are_those_of_the_plain_parse(parsing):
    given = texts(2)
    for text, got in zip(given, fingerprint_texts(given, parsing)):
        level, names, below = plain_fingerprint(text, parsing)
        assert (got.level, got.names.tolist(), got.below.tolist()) == (level, names, below)
        again = Fingerprint.of_text(got.text())
        assert again.names.tolist() == names and again.below.tolist() == below


def test_equal_substrings_share_signatures_at_any_offset():
    rng = random.Random(3)
    for _ in range(20):
        shared = prose(rng, 120)
        texts = [prose(rng, rng.randint(0, 60)) + shared + prose(rng, rng.randint(0, 60)) for _ in range(2)]
        for level, margin in ((1, 12), (2, 60), (3, 250)):
            inside = []
            for text in texts:
                at = text.index(shared)
                inside.append(
                    {(b - at, e - at, name) for b, e, name in phrases(text, level) if b >= at + margin and e <= at + len(shared) - margin}
                )
            assert inside[0] and inside[0] == inside[1]


def test_phrases_cover_a_text_and_stay_short():
    for text in texts(4):
        for level in range(4):
            found = phrases(text, level)
            assert "".join(text[b:e] for b, e, _ in found) == text
            by_name = {}
            for b, e, name in found:
                assert by_name.setdefault(name, text[b:e]) == text[b:e]
    rng = random.Random(5)
    mixture = "".join(rng.choices("abcdefgh", k=20_000))
    names, first = np.array([ord(c) for c in mixture], np.uint64), np.zeros(20_000, bool)
    first[0] = True
    for _ in range(3):
        before = len(names)
        names, first, begins = next_level(names, first)
        assert 2 <= before / len(names) <= 6


def test_likeness_tells_edited_texts_from_others():
    rng = random.Random(6)
    given = [prose(rng, rng.randint(30, 900)) for _ in range(60)]
    prints = fingerprint_texts(given)
    edits = fingerprint_texts([edited_text(a, b) for a, b in zip(given, given[1:] + given[:1])])
    near = [likeness(a, b) for a, b in zip(prints, edits)]
    far = [likeness(a, b) for a, b in zip(prints, prints[1:] + prints[:1])]
    assert min(near) > max(far) and sum(near) / len(near) > 0.5 and sum(far) / len(far) < 0.1
    assert all(likeness(a, a) == 1.0 for a in prints)


def plain_rows(rows, parsing):
    """The report by definition: all rows in order, one after the other."""
    rows = [(i, text or "") for i, text in rows]
    spots = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, -(rows[n][0] or 0)))
    out = []
    for at, spot in enumerate(spots):
        doc_id, text = rows[spot]
        following = rows[spots[(at + 1) % len(spots)]][1]
        edit = edited_text(text, following)
        own, other, changed = (
            Fingerprint(level, np.array(a, "<u4"), np.array(b, "<u4"))
            for level, a, b in (plain_fingerprint(t, parsing) for t in (text, following, edit))
        )
        out.append(
            (doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), own.text(), changed.text(),
             likeness(own, changed), likeness(own, other))
        )
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "p", "q") for i, t in rows], SCHEMA)


def report(spark, rows):
    return sorted((tuple(r) for r in fingerprints_against_next(frame(spark, rows)).collect()), key=repr)


def test_report_matches_the_plain_order(spark):
    rng = random.Random(7)
    rows = [(i * 3 % 101 - 20, text) for i, text in enumerate(texts(7) + texts(8) + [None])]
    rows += [(1000 + i, prose(rng, 30)) for i in range(50)]
    rng.shuffle(rows)
    assert report(spark, rows) == plain_rows(rows, Parsing())


def test_repeated_missing_and_single_rows(spark):
    same = [(5, "one text that all these rows repeat")] * 200 + [(None, None)] * 3 + [(4, "")]
    assert report(spark, same) == plain_rows(same, Parsing())
    assert report(spark, [(1, "alone here")]) == plain_rows([(1, "alone here")], Parsing())
    assert fingerprints_against_next(frame(spark, [])).count() == 0


def test_many_rows_of_one_id_fill_several_ranges(spark):
    rows = [(None if i % 2 else 7, f"text number {i} " * 5) for i in range(4000)]
    found = fingerprints_against_next(frame(spark, rows)).collect()
    assert len(found) == 4000
    assert sorted(f.fingerprint for f in found) == sorted(
        f.text() for f in fingerprint_texts([text for _, text in rows])
    )


def test_very_long_text_is_parsed_whole(spark):
    rng = random.Random(9)
    long = prose(rng, 150_000)
    rows = [(2, long), (1, long[:-1] + "!")]
    got = {r.doc_id: r for r in fingerprints_against_next(frame(spark, rows)).collect()}
    assert got[2].n_chars == len(long) and got[2].near_next > 0.9
    assert got[2].fingerprint == fingerprint_texts([long])[0].text()


def test_fingerprints_and_phrases_as_tables(spark):
    rows = [(i, text) for i, text in enumerate(texts(10))]
    got = dict(document_fingerprints(frame(spark, rows)).collect())
    assert got == {i: f.text() for i, f in enumerate(fingerprint_texts([t for _, t in rows]))}
    found = document_phrases(frame(spark, rows), 2).collect()
    assert sorted((r.doc_id, r.begin, r.end, int(r.name, 16)) for r in found) == sorted(
        (i, *phrase) for i, text in rows for phrase in phrases(text, 2)
    )
