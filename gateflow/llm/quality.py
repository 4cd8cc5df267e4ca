"""Document quality by attention over passages (multiple-instance learning).

A text is a bag of passages of a fixed number of words. Every passage is encoded: shares
of character classes, lengths and repetitions of its words give a vector, a layer
turns it into a hidden one. Gated attention, learnt from labels of documents alone,
weighs the passages, and the weighted sum is scored. Features are worked out with
arrays over whole batches of texts; a text longer than a batch is taken piece by
piece, so memory does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import arrow_schema, give_back, hash_remainder
from gateflow.llm.toxicity import label_marks

_PASSAGE = 64
_PIECE = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"

#: One character class per byte, by what it says about prose.
_GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b".,;:?",
    b"!",
    b"#",
    b"*",
    b"$",
    b"%",
    b"&",
    b"|",
    b"<>{}[]()=/\\_+~^@",
    b"'\"`-",
    b" ",
    b"\n",
    b"\t\r\x0b\x0c",
]
_CLASS = np.full(256, len(_GROUPS), dtype=np.uint8)  # the rest: other alphabets
for _index, _members in enumerate(_GROUPS):
    _CLASS[list(_members)] = _index
_N_CLASSES = len(_GROUPS) + 1
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(_SPACE)] = True
#: Shares of classes; mean and spread of word lengths; words equal to the one before,
#: to the one two before; share of distinct words; how full the passage is.
N_FEATURES = _N_CLASSES + 6


def _piece_features(data: np.ndarray) -> np.ndarray:
    """Features of the passages of one text piece, given as bytes; one row at least."""
    space = _IS_SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(starts) == 0:
        return np.zeros((1, N_FEATURES))
    n_words = len(starts)
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    lengths = ends - starts
    passage = np.arange(n_words) // _PASSAGE
    n = int(passage[-1]) + 1
    per = np.bincount(passage, minlength=n).astype(float)
    # A passage reaches from its first word to the next passage's first word.
    edge = starts[::_PASSAGE].copy()
    edge[0] = 0
    of_byte = np.repeat(np.arange(n), np.diff(np.append(edge, len(data))))
    counts = np.bincount(of_byte * _N_CLASSES + _CLASS[data], minlength=n * _N_CLASSES)
    counts = counts.reshape(n, _N_CLASSES).astype(float)
    shares = counts / counts.sum(axis=1, keepdims=True)
    # Places within words; what stands before the first word is white space.
    since = np.append(0, np.repeat(starts, np.diff(np.append(starts, len(data)))))
    inside = np.arange(len(data)) - np.concatenate([np.zeros(starts[0], np.int64), since[1:]])
    weight = (inside.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (data.astype(np.uint64) + np.uint64(1)) * (weight ^ (weight >> np.uint64(32)))
    mixed[space] = 0
    words = np.add.reduceat(mixed, starts)
    same1 = np.concatenate([[False], words[1:] == words[:-1]])
    same2 = np.concatenate([[False] * min(2, n_words), words[2:] == words[:-2]])
    order = np.lexsort((words, passage))
    sorted_words, sorted_passage = words[order], passage[order]
    new = np.concatenate(
        [[True], (sorted_words[1:] != sorted_words[:-1]) | (sorted_passage[1:] != sorted_passage[:-1])]
    )
    mean = np.bincount(passage, lengths, n) / per
    square = np.bincount(passage, lengths.astype(float) ** 2, n) / per
    columns = [
        np.minimum(mean / 10, 5),
        np.minimum(np.sqrt(np.maximum(square - mean**2, 0)) / 10, 5),
        np.bincount(passage, same1, n) / per,
        np.bincount(passage, same2, n) / per,
        np.bincount(sorted_passage, new, n) / per,
        per / _PASSAGE,
    ]
    return np.column_stack([shares, *columns])


def passages(text: str) -> np.ndarray:
    """Feature rows of all passages of a text; an empty one has one row of zeros.

    Pieces end at white space, so no word is cut unless it is longer than a piece.
    """
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if len(data) <= _PIECE:
        return _piece_features(data) if len(data) else np.zeros((1, N_FEATURES))
    rows, at = [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        if end < len(data):
            blanks = np.flatnonzero(_IS_SPACE[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
        rows.append(_piece_features(data[at:end]))
        at = end
    return np.vstack(rows)


class AttentionModel:
    """Gated attention over passages, trained by Adam on whole bags."""

    def __init__(self, hidden: int = 24, gate: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)

        def layer(a: int, b: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(a), (a, b))

        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {
            "E": layer(N_FEATURES, hidden),
            "e": np.zeros(hidden),
            "V": layer(hidden, gate),
            "U": layer(hidden, gate),
            "w": layer(gate, 1)[:, 0],
            "o": layer(hidden, 1)[:, 0],
            "b": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["E"] + p["e"])
        t = np.tanh(h @ p["V"])
        s = 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (t * s) @ p["w"]
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        a = raw / np.repeat(np.add.reduceat(raw, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["b"], -30, 30)))
        return {"sizes": sizes, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        x = (np.vstack(bags) - self.mean) / self.scale
        return self._forward(np.clip(x, -6, 6), starts)["y"]

    def gradients(
        self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray
    ) -> dict[str, np.ndarray]:
        """Of the weighted log loss, by parameter."""
        p, f = self.p, self._forward(x, starts)
        d = weights * (f["y"] - labels)
        dz = np.repeat(d, f["sizes"])[:, None] * p["o"]
        da = (dz * f["h"]).sum(axis=1)
        inner = np.add.reduceat(f["a"] * da, starts)
        draw = f["a"] * (da - np.repeat(inner, f["sizes"]))
        dt = draw[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = draw[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        dh *= 1 - f["h"] ** 2
        return {
            "E": x.T @ dh,
            "e": dh.sum(axis=0),
            "V": f["h"].T @ dt,
            "U": f["h"].T @ ds,
            "w": (f["t"] * f["s"]).T @ draw,
            "o": f["z"].T @ d,
            "b": np.array([d.sum()]),
        }

    def fit(
        self,
        bags: list[np.ndarray],
        labels: np.ndarray,
        weights: np.ndarray,
        steps: int = 400,
        rate: float = 0.02,
        decay: float = 1e-4,
    ) -> AttentionModel:
        if not bags:
            return self
        x = np.vstack(bags)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        weights = weights / weights.sum()
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            grads = self.gradients(x, starts, labels, weights)
            for k, g in grads.items():
                g = g + decay * self.p[k]
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                m = first / (1 - 0.9**step)
                v = second / (1 - 0.999**step)
                self.p[k] = self.p[k] - rate * m / (np.sqrt(v) + 1e-8)
        return self


def _bags(rows: DataFrame) -> DataFrame:
    """doc_id, quality and features of the passages of few rows."""
    schema = "doc_id long, quality int, bag binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [
                passages(text).astype(np.float32).tobytes()
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(bags, pa.binary())],
                schema=arrow_schema(schema),
            )

    return rows.select("doc_id", "quality", "text").mapInArrow(run, schema)


def train_quality(
    docs: DataFrame, marks: DataFrame, fit_rows: int = 1500, share_below: float = 0.5
) -> AttentionModel:
    """Model from documents and their labels (doc_id, quality).

    At most ``fit_rows`` documents of each label are taken, those with the smallest
    hashes; only their texts move. ``share_below`` weighs the low label against the
    other.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    present = marks.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for value in (0, 1):
        ids = (
            present.filter(F.col("quality") == value)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(fit_rows)
        )
        chosen = ids if chosen is None else chosen.unionAll(ids)
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    table = _bags(rows).orderBy("doc_id").toArrow()
    labels = np.array(table.column("quality").to_pylist(), dtype=float)
    bags = [
        np.frombuffer(value, dtype=np.float32).reshape(-1, N_FEATURES).astype(float)
        for value in table.column("bag").to_pylist()
    ]
    low = max((labels == 0).sum(), 1)
    high = max((labels == 1).sum(), 1)
    weights = np.where(labels == 0, share_below / low, (1 - share_below) / high)
    return AttentionModel().fit(bags, labels, weights)


def score_quality(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    A missing text counts as empty and is scored as one empty passage; repeated rows
    stay; an empty table gives no row.
    """
    schema = "doc_id long, score double"
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 128):
                batch = whole.slice(begin, 128)
                bags = [passages(text) for text in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(model.scores(bags), pa.float64())],
                    schema=arrow_schema(schema),
                )

    return rows.mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its fold, score and prediction."""
    held_out = hash_remainder("doc_id", 5) == 0
    model = train_quality(docs, label_marks(labels, "quality").filter(~held_out))
    return score_quality(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text scores below ``threshold``.

    The model learns from the labels of the rows that are not held out. All columns
    stay as they are, whatever their names.
    """
    held_out = hash_remainder("doc_id", 5) == 0
    model = train_quality(docs, label_marks(labels, "quality").filter(~held_out))

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 128):
                batch = whole.slice(begin, 128)
                bags = [passages(text or "") for text in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(model.scores(bags) >= threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
