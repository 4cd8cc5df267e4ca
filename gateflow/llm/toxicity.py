"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon is learnt from labelled rows: a term (a word, or the stem of a family of
words) belongs to it if it stands in several different contexts of toxic texts and in
a far larger share of them than of the others. Contexts are told apart by the word
before, hashed to one of 64 bits, a long that merges by OR; shares are those of
distinct texts, as each of m exact or near copies counts 1/m. A Levenshtein automaton walks the trie of the lexicon with
each distinct word of a text, so misspelled terms are caught, also those written with
signs between their letters; a word goes there only if it shares a piece with a term,
which every word within reach does. Words near a term that other texts use as words of
their own are no misspellings. Around each find a window tells quotation (quotes, verbs
of saying) from abuse (the second person). A logistic model of the window scores, fitted
to a bounded sample of labelled rows, gives the score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import arrow_schema, hash_remainder
from gateflow.operators.joins import broadcast_if_small
from gateflow.session import store_table

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Runs of letters and digits with one sign between each two of them.
_SIGNED = re.compile(r"(?<![^\W_])[^\W_]++(?:(?:[^\w\s]|_)[^\W_]++)+")
_SIGN = re.compile(r"[\W_]")
_QUOTES = frozenset("\"“”„«»‹›‘‚`")
#: Verbs and nouns that report a word, and second persons (fixed values).
_REPORT = frozenset(
    "said says say saying wrote writes called calls calling word term quote quoted "
    "sagte sagt schrieb wort begriff dit disait mot terme dijo dice palabra término".split()
)
_SECOND = frozenset("you your youre u ur du dein deine dich ihr tu te toi ton vous tú eres usted".split())
_REACH = 5
FEATURES = (
    "any_abuse",
    "log_abuse",
    "density",
    "any_quoted",
    "log_quoted",
    "any_misspelt",
    "log_misspelt",
    "log_second_person",
)


def _signature(text: str) -> int:
    """The smallest hash of five words in a row, which near copies mostly share."""
    words = _WORD.findall(text.lower())
    ids = np.fromiter((crc32(w.encode()) for w in words), dtype=np.uint64, count=len(words))
    n = max(1, len(ids) - 4)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(min(5, len(ids))):
        mixed = (mixed ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return int(mixed.min().view(np.int64))


def _signed_texts(rows: DataFrame) -> DataFrame:
    """text, toxic and the signature of the text."""
    schema = "text string, toxic boolean, hash long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_signature(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text"), batch.column("toxic"), pa.array(hashes, pa.int64())],
                schema=arrow_schema(schema),
            )

    return rows.select("text", (F.col("toxic") > 0).alias("toxic")).mapInArrow(run, schema)


def _word_counts(rows: DataFrame, longest: int) -> DataFrame:
    """word, a 64-bit set of its contexts in toxic texts, and the texts that hold it.

    ``rows`` has text, toxic and weight; texts are summed weights. Beginnings of four
    to ``longest`` letters of longer words have rows of their own, marked by a star and
    without contexts: a text with many words of a family counts once there.
    """
    schema = "word string, contexts long, toxic double, other double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: dict = {}
        texts: tuple[dict, dict] = ({}, {})

        def flush() -> pa.RecordBatch:
            words = list(set(texts[0]) | set(texts[1]))
            masks = np.array([contexts.get(w, 0) for w in words], dtype=np.uint64).view(np.int64)
            sums = [pa.array([t.get(w, 0.0) for w in words], pa.float64()) for t in (texts[1], texts[0])]
            for held in (contexts, *texts):
                held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(masks), *sums],
                schema=arrow_schema(schema),
            )

        for batch in batches:
            for text, label, weight in zip(
                *(batch.column(name).to_pylist() for name in ("text", "toxic", "weight"))
            ):
                words = _WORD.findall(text.lower())
                distinct = set(words)
                held = texts[label]
                heads = {f"{w[:k]}*" for w in distinct for k in range(4, min(len(w) - 1, longest) + 1)}
                for word in distinct | heads:
                    held[word] = held.get(word, 0.0) + weight
                if label:
                    bits = {w: 1 << (sum(w.encode()) * 37 + len(w)) % 64 for w in distinct}
                    before = 1
                    for word in words:
                        contexts[word] = contexts.get(word, 0) | before
                        before = bits[word]
            if len(texts[0]) + len(texts[1]) > 400_000:
                yield flush()
        yield flush()

    return (
        rows.mapInArrow(run, schema)
        .groupBy("word")
        .agg(F.bit_or("contexts").alias("contexts"), F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    )


def learn_lexicon(
    rows: DataFrame,
    most_contexts: int = 5,
    ratio: int = 12,
    least_share: float = 0.002,
    longest: int = 40,
) -> tuple[list[tuple[str, bool]], frozenset[str]]:
    """Terms (text, is a stem) from labelled rows (text, toxic), and words that are none.

    A word or prefix qualifies with enough different contexts in toxic texts, and if
    the share of toxic texts that hold it, less two standard errors, is ``ratio``
    times that of the others, where half a text more counts as seen. Enough is a tenth of
    the toxic texts, but three at least and ``most_contexts`` at most. A stem
    is the beginning of longer words (the word that it is by itself may be another one),
    has at least four letters and three different words, and stands in half as many toxic
    texts again as any of them; the shortest qualifying prefix stands for its family.
    A term stands in ``least_share`` of the distinct toxic texts, so terms are at most the
    mean number of distinct words and beginnings of such a text divided by that share,
    however many texts there are. It has ``longest`` letters at most.

    Words within reach of a term are no misspellings of it if two or more other texts
    hold them and toxic texts do not hold them three times as often.
    """
    marked = _signed_texts(rows)
    copies = store_table(marked.groupBy("hash", "toxic").agg(F.count("*").alias("copies")))
    n_rows, n_toxic, n_other = copies.agg(
        F.sum(F.when(F.col("toxic"), F.col("copies"))), F.count_if("toxic"), F.count_if(~F.col("toxic"))
    ).first()
    least_contexts = max(3, min(most_contexts, (n_rows or 0) // 10))
    repeated = broadcast_if_small(copies.filter("copies > 1"))
    weighed = marked.join(repeated, ["hash", "toxic"], "left").select(
        "text", "toxic", (1 / F.coalesce("copies", F.lit(1))).alias("weight")
    )
    held = store_table(_word_counts(weighed, longest))
    counts = held.filter(f"length(word) <= {longest} AND NOT endswith(word, '*')")
    heads = held.filter("endswith(word, '*')").select(
        F.expr("left(word, length(word) - 1)").alias("word"), "toxic", "other"
    )
    enough = (
        f"bit_count(contexts) >= {least_contexts} AND toxic >= {least_share} * {n_toxic} AND "
        f"(toxic - 2 * sqrt(toxic)) * {n_other} >= {ratio} * (other + 0.5) * {n_toxic}"
    )
    words = counts.filter(enough).select("word", F.lit(False).alias("stem"))
    prefixes = (
        counts.filter("length(word) > 4").select(
            F.explode(F.expr("transform(sequence(4, length(word) - 1), i -> left(word, i))")).alias("word"),
            "contexts",
            F.col("toxic").alias("own"),
        )
        .groupBy("word")
        .agg(
            F.bit_or("contexts").alias("contexts"),
            F.count("*").alias("members"),
            F.max("own").alias("largest"),
        )
        .filter(f"members >= 3 AND bit_count(contexts) >= {least_contexts}")
        .join(heads, "word")
        .filter(f"{enough} AND toxic >= 1.5 * largest")
        .select("word", F.lit(True).alias("stem"))
    )
    terms = store_table(words.unionAll(prefixes))
    stems = terms.filter("stem").select(F.col("word").alias("head"))
    # Beginnings that would make the term a member of a shorter family.
    shorter = F.expr("transform(sequence(4, length(word) - 1), i -> left(word, i))")
    members = terms.filter("length(word) > 4").select("word", "stem", F.explode(shorter).alias("head")).join(stems, "head")
    alone = terms.join(members.select("word", "stem").distinct(), ["word", "stem"], "left_anti")
    found = [(row.word, row.stem) for row in alone.orderBy("word", "stem").collect()]
    other_words = counts.filter(f"other >= 2 AND toxic * {n_other} < 3 * other * {n_toxic}")
    return found, frozenset(row.word for row in _near_words(other_words, found).collect())


def _near_words(words: DataFrame, terms: list[tuple[str, bool]]) -> DataFrame:
    """The rows of ``words`` that lie within the reach of a term but are none."""
    shared = words.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            finds = ((word, trie.find(word)) for word in batch.column("word").to_pylist())
            near = [word for word, find in finds if find and find[1]]
            yield pa.RecordBatch.from_pydict({"word": near}, schema=arrow_schema("word string"))

    return words.select("word").mapInArrow(run, "word string")


def edits_allowed(term: str, stem: bool = False) -> int:
    """Edits within which a word still is ``term``: one from four letters, two from nine.

    A stem allows none, as beginnings within an edit of it are met by far more words.
    """
    return 0 if stem else (len(term) >= 4) + (len(term) >= 9)


class _Node:
    """Node of the trie; ``reach`` is the most edits that a term at or below it allows."""

    __slots__ = ("children", "ends", "reach")

    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.ends: dict[bool, str] = {}
        self.reach = 0


def _pieces(term: str, stem: bool) -> Iterator[str]:
    """Patterns of which each word within the edits allowed for ``term`` has one.

    The term is cut into one piece more than there are edits, so an edit within a piece
    leaves another whole. A swap of the letters on both sides of a cut joins its pieces.
    """
    edits = edits_allowed(term, stem)
    cuts = [len(term) * k // (edits + 1) for k in range(1, edits + 1)]
    for swaps in product((False, True), repeat=edits):
        letters = list(term)
        for cut in (c for c, swap in zip(cuts, swaps) if swap):
            letters[cut - 1], letters[cut] = letters[cut], letters[cut - 1]
        borders = [0, *(c for c, swap in zip(cuts, swaps) if not swap), len(term)]
        for begin, end in zip(borders, borders[1:]):
            piece = re.escape("".join(letters[begin:end]))
            if begin == 0:
                yield f"^{piece}" if end < len(term) or stem else f"^{piece}$"
            elif end == len(term) and not stem:
                yield f"{piece}$"
            else:
                yield f"^.{{{max(0, begin - edits)},{begin + edits}}}{piece}"


class Trie:
    """Lexicon trie; ``find`` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, terms: list[tuple[str, bool]], none: frozenset[str] = frozenset()):
        self.root, self.none = _Node(), none
        patterns = set()
        for term, stem in terms:
            node = self.root
            node.reach = max(node.reach, edits_allowed(term, stem))
            for letter in term:
                node = node.children.setdefault(letter, _Node())
                node.reach = max(node.reach, edits_allowed(term, stem))
            node.ends[stem] = term
            patterns.update(_pieces(term, stem))
        self.may_match = re.compile("|".join(sorted(patterns)) or "(?!)", re.DOTALL).search

    def find(self, word: str) -> tuple[str, int] | None:
        """The term within reach of ``word`` and its edits, the fewest first.

        An edit is an insertion, a deletion, another letter or a swap of neighbours;
        ``edits_allowed`` says how many a term may have. A stem is met by the beginning
        of a longer word. A word of ``none`` is no misspelling.
        """
        if not self.may_match(word):
            return None
        best: tuple[str, int] | None = None
        states: dict[tuple, tuple[_Node, int, str]] = {}
        self._reach(states, self.root, 0)
        for at in range(len(word) + 1):
            for node, edits, expected in states.values():
                for stem, term in node.ends.items():
                    met = not expected and stem == (at < len(word)) and edits <= edits_allowed(term, stem)
                    if met and (best is None or edits < best[1]):
                        best = (term, edits)
            if at == len(word):
                break
            after: dict[tuple, tuple[_Node, int, str]] = {}
            for node, edits, expected in states.values():
                self._step(after, node, edits, expected, word[at])
            states = after
            if not states:
                break
        if best is not None and best[1] and word in self.none:
            return None
        return best

    def _reach(self, states: dict, node: _Node, edits: int, expected: str = "") -> None:
        """Enter a state, and those behind it where letters of the term are left out.

        ``expected`` is the first of two swapped letters, which the word still owes.
        """
        if edits > node.reach:
            return
        held = states.get((id(node), expected))
        if held is not None and held[1] <= edits:
            return
        states[id(node), expected] = (node, edits, expected)
        if not expected:
            for child in node.children.values():
                self._reach(states, child, edits + 1)

    def _step(self, after: dict, node: _Node, edits: int, expected: str, letter: str) -> None:
        if expected:
            if letter == expected:
                self._reach(after, node, edits)
            return
        child = node.children.get(letter)
        if child is not None:
            self._reach(after, child, edits)
        if edits < node.reach:
            self._reach(after, node, edits + 1)
            for key, child in node.children.items():
                if key == letter:
                    continue
                self._reach(after, child, edits + 1)
                swapped = child.children.get(letter)
                if swapped is not None:
                    self._reach(after, swapped, edits + 1, key)


def _joined_finds(lower: str, cache: dict, trie: Trie) -> list[tuple[int, int]]:
    """Places of words that are a term once the single signs among their letters go.

    Places with a word that is a find by itself are left out.
    """
    places = []
    for match in _SIGNED.finditer(lower):
        word = match.group()
        if any(cache.get(part) for part in _WORD.findall(word)):
            continue
        joined = _SIGN.sub("", word)
        if joined not in cache:
            cache[joined] = trie.find(joined)
        find = cache[joined]
        # A beginning would make a find of any list that has signs for spaces.
        if find and abs(len(joined) - len(find[0])) <= 2:
            places.append(match.span())
    return places


def text_features(text: str, trie: Trie, cache: dict) -> list[float]:
    """``FEATURES`` of a text: how its finds stand in their windows.

    Abuse is any find outside a quotation; misspelt ones among it count once more.
    """
    lower = text.lower()
    distinct = set(_WORD.findall(lower))
    for word in distinct.difference(cache):
        cache[word] = trie.find(word)
    hits = {word for word in distinct if cache[word]}
    signed = _joined_finds(lower, cache, trie)
    if not hits and not signed:
        return [0.0] * len(FEATURES)
    matches = list(_WORD.finditer(lower))
    words = [match.group() for match in matches]
    starts = [match.start() for match in matches]
    # First and last word, place in the text, and whether the spelling is another one.
    finds = [
        (i, i, matches[i].span(), bool(cache[word][1])) for i, word in enumerate(words) if word in hits
    ]
    for start, end in signed:
        finds.append((bisect_left(starts, start), bisect_left(starts, end) - 1, (start, end), True))
    abuse = quoted = misspelt = second = 0
    for first, last, (start, end), other_spelling in finds:
        near = words[max(0, first - _REACH) : first] + words[last + 1 : last + 1 + _REACH]
        marks = lower[max(0, start - 2) : start] + lower[end : end + 2]
        if any(m in _QUOTES for m in marks) and (_REPORT.intersection(near) or sum(m in _QUOTES for m in marks) > 1):
            quoted += 1
            continue
        second += bool(_SECOND.intersection(near))
        abuse += 1
        misspelt += other_spelling
    return [
        float(abuse > 0),
        float(np.log1p(abuse)),
        100.0 * abuse / len(words),
        float(quoted > 0),
        float(np.log1p(quoted)),
        float(misspelt > 0),
        float(np.log1p(misspelt)),
        float(np.log1p(second)),
    ]


def lexicon_features(
    docs: DataFrame, terms: list[tuple[str, bool]], none: frozenset[str] = frozenset()
) -> DataFrame:
    """doc_id and the window scores of every row."""
    schema = "doc_id long, " + ", ".join(f"{name} double" for name in FEATURES)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    shared = docs.sparkSession.sparkContext.broadcast((terms, none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, cache = Trie(*shared.value), {}
        for batch in batches:
            if len(cache) > 300_000:
                cache.clear()
            values = [text_features(t, trie, cache) for t in batch.column("text").to_pylist()]
            columns = zip(*values) if values else [[] for _ in FEATURES]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.float64()) for c in columns)],
                schema=arrow_schema(schema),
            )

    return rows.mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if len(y) == 0:
        return w
    ridge = penalty * np.eye(len(w)) * len(y) / 100
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + ridge, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def label_marks(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and its label, the larger one where labels repeat or differ."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max(label).alias(label))
    )


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Documents with their label; the larger one where labels repeat or differ.

    Rows without a doc_id or a label do not take part. Labels are measured and
    broadcast while they are small, so that texts need not move to meet them.
    """
    marks = broadcast_if_small(label_marks(labels, label))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return texts.join(marks, "doc_id")


def score_toxicity(
    docs: DataFrame, training: DataFrame, fit_rows: int = 20_000
) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``.

    ``training`` has doc_id, text and toxic. All of it makes the lexicon; the logistic
    model takes at most ``fit_rows`` of its rows, those with the smallest hashes. A
    missing text counts as empty and gets the score of a text without a find;
    repeated rows stay; without training rows every score is 0.5.
    """
    terms, none = learn_lexicon(training.select("text", "toxic"))
    features = store_table(lexicon_features(docs, terms, none))
    marks = training.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = features.join(F.broadcast(marks), "doc_id").dropDuplicates(["doc_id"]).toPandas()
    w = fit_logistic(sample[list(FEATURES)].to_numpy(float), sample["toxic"].to_numpy(float))
    logit = F.lit(float(w[-1]))
    for name, weight in zip(FEATURES, w):
        logit = logit + F.lit(float(weight)) * F.col(name)
    return features.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its fold, score and prediction."""
    held_out = hash_remainder("doc_id", 3) == 1
    training = labelled(docs, labels, "toxic").filter(~held_out)
    return score_toxicity(docs, training).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
