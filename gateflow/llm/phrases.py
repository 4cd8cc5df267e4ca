"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. At each level runs of one name become one name with its
length; then deterministic coin tossing (the lowest bit in which a name differs from
the one before it, four times over) leaves labels below 6 of which no two neighbours
are equal, and a phrase begins at each local maximum of the labels. A phrase is named
by a hash of the names in it. Whether a phrase begins somewhere depends on a few
neighbours only, so equal substrings are parsed alike but for their ends, at whatever
offset and in whatever document they stand, and no dictionary has to be shared.

A fingerprint holds the smallest names of two neighbouring levels: of the highest
level with enough phrases, and of the one below, so that texts of somewhat different
length have a level in common; a name counts as often as it occurs. Likeness is the share of phrases that two texts have in
common, by the names that both would keep.

Missing texts are empty; an empty text has an empty fingerprint, which is like itself
(1) and unlike all others (0). Rows that repeat an id stay rows of their own. All other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import arrow_schema, document_columns, map_batches
from gateflow.session import store_table

#: Code points of texts that are parsed together; a longer text is parsed alone.
CHUNK = 400_000

_ROUNDS = 4
_LOWEST = np.array([8] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)
_RADIX = 0x9E3779B97F4A7C15
# A phrase has 10 names at most, one at the begin of a text 11.
_POWERS = np.array([pow(_RADIX, i, 1 << 64) for i in range(32)], np.uint64)


@dataclass(frozen=True)
class Parsing:
    """How far a text is parsed, and what its fingerprint keeps.

    ``levels`` is the highest level, ``least`` the number of phrases a text must have
    there (else a lower level counts), ``kept`` the number of names kept of that level
    and ``kept_below`` that of the level below.
    """

    levels: int = 3
    least: int = 10
    kept: int = 64
    kept_below: int = 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _before(x: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[0], out[1:] = 0, x[:-1]
    return out


def next_level(
    names: np.ndarray, first: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of one or more texts: names, whether first of a text, begin.

    ``first`` marks the first name of each text; no phrase crosses it.
    """
    if not len(names):
        return names, first, np.empty(0, np.int64)
    runs = np.flatnonzero(first | (names != _before(names)))
    length = np.diff(runs, append=len(names)).astype(np.uint64)
    names, first = names[runs], first[runs]
    long = length > 1
    names[long] = _mixed(names[long] + _mixed(length[long]))

    differ = names ^ _before(names)
    differ[first] = 1
    place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    bit = (names >> place.astype(np.uint64)).astype(np.uint8) & 1
    labels = 2 * place + bit
    for _ in range(_ROUNDS - 1):
        differ = labels ^ _before(labels)
        differ[first] = 1
        place = _LOWEST[differ]
        labels = 2 * place + (labels >> place & 1)

    after = np.empty_like(labels)
    after[-1], after[:-1] = 255, labels[1:]
    after[:-1][first[1:]] = 255
    begins = (labels > _before(labels)) & (labels > after) & ~_before(first)
    begins = np.flatnonzero(begins | first)
    inside = np.arange(len(names)) - np.repeat(
        begins, np.diff(begins, append=len(names))
    )
    sums = np.add.reduceat(names * _POWERS[inside], begins)
    return _mixed(sums), first[begins], runs[begins]


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where a text begins."""
    joined = "".join(texts).encode("utf-32-le")
    points = np.frombuffer(joined, np.uint32).astype(np.uint64)
    ends = np.cumsum([len(text) for text in texts])
    first = np.zeros(len(points), bool)
    first[[end - len(text) for text, end in zip(texts, ends) if text]] = True
    return points, first


def phrases(text: str, level: int) -> list[tuple[int, int, int]]:
    """Begin, end (exclusive) and name of the phrases of a text at ``level``."""
    names, first = _code_points([text])
    begins = np.arange(len(names))
    for _ in range(level):
        names, first, places = next_level(names, first)
        begins = begins[places]
    ends = np.append(begins[1:], len(text))[: len(begins)]
    return list(zip(begins.tolist(), ends.tolist(), names.tolist()))


@dataclass(frozen=True)
class Fingerprint:
    """The level, and the kept names (24 bits each) there and one level below.

    A text keeps the smallest names; 24 bits tell them well apart, as two texts are
    compared by some dozens.
    """

    level: int
    names: np.ndarray
    below: np.ndarray

    def packed(self) -> bytes:
        """A byte for the level, two for the number of names, three for each name."""
        head = self.level.to_bytes(1, "little") + len(self.names).to_bytes(2, "little")
        names = np.concatenate([self.names, self.below]).astype("<u4")
        return head + names.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()

    @staticmethod
    def of_packed(packed: bytes) -> Fingerprint:
        n = int.from_bytes(packed[1:3], "little")
        names = np.zeros(((len(packed) - 3) // 3, 4), np.uint8)
        names[:, :3] = np.frombuffer(packed[3:], np.uint8).reshape(-1, 3)
        names = names.view("<u4").ravel()
        return Fingerprint(packed[0], names[:n], names[n:])

    def text(self) -> str:
        return base64.b64encode(self.packed()).decode()

    @staticmethod
    def of_text(text: str) -> Fingerprint:
        return Fingerprint.of_packed(base64.b64decode(text))


def likeness(
    one: Fingerprint, other: Fingerprint, parsing: Parsing = Parsing()
) -> float:
    """Share of phrases in common, 0 to 1, of the mean number of phrases.

    Estimated from the smallest names of both texts together, as many as are known from
    both fingerprints; exact where both texts have fewer. Texts without a level in
    common differ in length by so much that they share next to nothing: 0.
    """
    kept = min(parsing.kept, parsing.kept_below)
    if one.level == other.level:
        a, b, kept = one.names, other.names, parsing.kept
    elif one.level == other.level + 1:
        a, b = one.below, other.names
    elif one.level + 1 == other.level:
        a, b = one.names, other.below
    else:
        return 0.0
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:kept]
    common = np.isin(union, np.intersect1d(a, b, assume_unique=True)).sum()
    return float(2 * common / (len(union) + common))


def _numbered(owner: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The text, then 24 bits of the name, as one number; ascending, without repeats.

    A name's second and later occurrences in a text are names of their own, so that
    texts are compared by all their phrases and not by the different ones alone.
    """
    high, taken = np.uint64(32), np.uint64(40)
    ordered = np.sort((owner << high) | (names >> taken))
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    repeat = np.arange(len(ordered)) - np.repeat(
        begins, np.diff(begins, append=len(ordered))
    )
    again = np.flatnonzero(repeat)
    of_name = (ordered[again] & np.uint64(0xFFFFFFFF)) | (
        repeat[again].astype(np.uint64) << high
    )
    ordered[again] = (ordered[again] >> high << high) | (_mixed(of_name) >> taken)
    return np.unique(ordered)


def fingerprint_texts(
    texts: list[str], parsing: Parsing = Parsing()
) -> list[Fingerprint]:
    n = len(texts)
    names, first = _code_points(texts)
    owners = np.flatnonzero([bool(text) for text in texts])
    found = []
    for level in range(parsing.levels + 1):
        if level:
            names, first, _ = next_level(names, first)
        found.append((names if level else _mixed(names), owners[np.cumsum(first) - 1]))
    counts = np.array([np.bincount(owner, minlength=n) for _, owner in found])
    enough = counts >= parsing.least
    top = np.where(enough, np.arange(parsing.levels + 1)[:, None], 0).max(axis=0)
    empty = np.empty(0, "<u4")
    kept = [[empty, empty] for _ in range(n)]
    for level, (names, owner) in enumerate(found):
        for place in (0, 1):
            wanted = top == level + place
            taken = wanted[owner] if len(owner) else np.empty(0, bool)
            if not taken.any():
                continue
            ordered = _numbered(owner[taken].astype(np.uint64), names[taken])
            whose = (ordered >> np.uint64(32)).astype(np.int64)
            begins = np.searchsorted(whose, np.arange(n + 1))
            low = (ordered & np.uint64(0xFFFFFFFF)).astype("<u4")
            most = parsing.kept_below if place else parsing.kept
            for text in np.flatnonzero(wanted):
                end = min(begins[text + 1], begins[text] + most)
                kept[text][place] = low[begins[text] : end]
    return [Fingerprint(int(top[i]), *kept[i]) for i in range(n)]


def _chunks(sizes: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with ``most`` code points together, or of one longer text."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def document_fingerprints(docs: DataFrame, parsing: Parsing = Parsing()) -> DataFrame:
    """doc_id and fingerprint of every whole text, without a shuffle."""

    def run(columns: dict) -> dict:
        texts, out = columns["text"], []
        for a, b in _chunks([len(text) for text in texts]):
            out += [f.text() for f in fingerprint_texts(texts[a:b], parsing)]
        return {"doc_id": columns["doc_id"], "fingerprint": out}

    return map_batches(document_columns(docs), run, "doc_id long, fingerprint string")


def document_phrases(docs: DataFrame, level: int = Parsing.levels) -> DataFrame:
    """doc_id, begin, end and name of every phrase of every text at ``level``.

    Equal names are equal passages: a join on the name finds passages that documents
    share, at whatever offset.
    """

    def run(columns: dict) -> dict:
        out: dict = {"doc_id": [], "begin": [], "end": [], "name": []}
        for doc_id, text in zip(columns["doc_id"], columns["text"]):
            for begin, end, name in phrases(text, level):
                out["doc_id"].append(doc_id)
                out["begin"].append(begin)
                out["end"].append(end)
                out["name"].append(f"{name:016x}")
        return out

    return map_batches(
        document_columns(docs), run, "doc_id long, begin long, end long, name string", 32
    )


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by the begin of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_RESULT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, "
    "edited_fingerprint binary, near_edited double, near_next double"
)
_RESULT = arrow_schema(_RESULT_SCHEMA).names
_EDGE_SCHEMA = f"part int, place int, {_RESULT_SCHEMA}, text string"
_INSIDE, _FIRST, _LAST = range(3)


def _compared(
    ids: list, texts: list[str], following: list[str], own: list[Fingerprint],
    others: list[Fingerprint], parsing: Parsing,
) -> dict[str, list]:
    """Result columns of texts whose next texts are known, with the fingerprints."""
    edits = [edited_text(a, b) for a, b in zip(texts, following)]
    prints = fingerprint_texts(edits, parsing)
    return {
        "doc_id": ids,
        "n_chars": [len(text) for text in texts],
        "edited_sha256": [hashlib.sha256(e.encode()).digest() for e in edits],
        "fingerprint": [f.packed() for f in own],
        "edited_fingerprint": [f.packed() for f in prints],
        "near_edited": [likeness(a, b, parsing) for a, b in zip(own, prints)],
        "near_next": [likeness(a, b, parsing) for a, b in zip(own, others)],
    }


def fingerprints_against_next(
    docs: DataFrame, parsing: Parsing = Parsing()
) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next one.

    The next document is the one with the next smaller doc_id, rows without an id come
    last, rows of one id are ordered by a hash of their text, and after the last row
    comes the first. Texts are dealt once, by ranges of (doc_id, hash), so an id with
    many rows fills several ranges, and are compared while a range is read in order.
    Only the first and the last text of each range are kept for a second step, which
    joins a range's last row with the first of the next range. The number of ranges is
    the session's number of shuffle partitions; their numbers alone come to the driver.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ranges = (
        document_columns(docs)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    target = arrow_schema(_EDGE_SCHEMA)

    def edge(part: int, place: int, doc_id, text: str) -> pa.RecordBatch:
        row = dict.fromkeys(target.names) | {"part": part, "place": place}
        row |= {"doc_id": doc_id, "text": text}
        return pa.RecordBatch.from_pylist([row], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[list, list, list] = ([], [], [])  # the last row so far
        for batch in batches:
            all_ids, all_texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            for a, b in _chunks([len(text) for text in all_texts]):
                if not held[0]:
                    yield edge(part, _FIRST, all_ids[a], all_texts[a])
                ids, texts = held[0] + all_ids[a:b], held[1] + all_texts[a:b]
                prints = held[2] + fingerprint_texts(all_texts[a:b], parsing)
                columns = _compared(
                    ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:], parsing
                )
                n = len(ids) - 1
                columns |= {"part": [part] * n, "place": [_INSIDE] * n, "text": [None] * n}
                yield pa.RecordBatch.from_pydict(columns, schema=target)
                held = (ids[-1:], texts[-1:], prints[-1:])
        if held[0]:
            yield edge(part, _LAST, held[0][0], held[1][0])

    stored = store_table(ranges.mapInArrow(run, _EDGE_SCHEMA))
    edges = stored.filter(F.col("place") != _INSIDE).select("part", "place", "doc_id", "text")
    filled = sorted(row["part"] for row in edges.filter(F.col("place") == _LAST).select("part").collect())
    follows = spark.createDataFrame(
        list(zip(filled, filled[1:] + filled[:1])), "part int, following int"
    )
    lasts = edges.filter(F.col("place") == _LAST).join(follows, "part")
    firsts = edges.filter(F.col("place") == _FIRST).select(
        F.col("part").alias("following"), F.col("text").alias("next_text")
    )

    def finish(columns: dict) -> dict:
        out: dict[str, list] = {name: [] for name in _RESULT}
        for doc_id, *pair in zip(columns["doc_id"], columns["text"], columns["next_text"]):
            own, other = fingerprint_texts(pair, parsing)
            row = _compared([doc_id], pair[:1], pair[1:], [own], [other], parsing)
            for name, values in row.items():
                out[name] += values
        return out

    pairs = lasts.join(firsts, "following").select("doc_id", "text", "next_text")
    joints = map_batches(pairs, finish, _RESULT_SCHEMA, 16)
    inside = stored.filter(F.col("place") == _INSIDE).select(*_RESULT)
    return inside.unionByName(joints).select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        *[
            F.translate(F.base64(name), "\r\n", "").alias(name)
            for name in ("fingerprint", "edited_fingerprint")
        ],
        "near_edited",
        "near_next",
    )
