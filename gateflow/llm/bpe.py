"""Byte-level BPE over a corpus, each distinct word encoded once.

The texts are dealt to blocks of a few megabytes. A block asks for the distinct words
it holds; the askings are shuffled by word, so that a word is encoded in one place
however many blocks hold it; the ids come back to the block, which puts them at every
position of the word. The most frequent words of a bounded sample are encoded first
and broadcast (their number is a parameter), which keeps words that every block holds
out of the shuffle. Which words these are changes the cost only.

Texts, askings and answers travel packed: lengths and bytes of many values in one,
compressed. The texts are packed before they are dealt, once, and read twice.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import arrow_schema, document_columns, give_back

_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: Characters outside this range may be letters, digits or white space by rules that
#: differ between libraries; texts that hold one take the general pattern.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xc0-ɏ]")
_ASK = "shard int, block int, payload binary"
_ANSWER = "block int, payload binary"


class Splitter:
    """Splits texts by a pre-tokenizer's pattern; the parts together are the text."""

    def __init__(self, pattern: str):
        spaced = pattern.replace(r"[^\s", r"[^\p{White_Space}")
        spaced = spaced.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTER}0-9]")
        plain = plain.replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", "[0-9]")
        self.general, self.plain = regex.compile(spaced), re.compile(plain)

    def __call__(self, text: str) -> list[str]:
        return (self.general if _UNUSUAL.search(text) else self.plain).findall(text)


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    pairs = (line.split() for line in content.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _encoder(held: dict) -> tiktoken.Encoding:
    """Encoder of a broadcast vocabulary, made once per worker."""
    if "encoder" not in held:
        held["encoder"] = tiktoken.Encoding(
            "corpus",
            pat_str=held["pattern"],
            mergeable_ranks=read_ranks(held["ranks"]),
            special_tokens={},
        )
    return held["encoder"]


def _word_ids(words: list[bytes], held: dict) -> list[bytes]:
    encode = _encoder(held)._encode_single_piece
    return [np.array(encode(word), dtype="<u4").tobytes() for word in words]


def _pack(*columns: list[bytes]) -> bytes:
    lengths = [np.array([len(v) for v in values], dtype="<u4") for values in columns]
    head = np.array([len(columns), len(columns[0])], dtype="<u4").tobytes()
    body = b"".join([*(x.tobytes() for x in lengths), *(b"".join(c) for c in columns)])
    return zstandard.compress(head + body, 1)


def _unpack(payload: bytes) -> list[list[bytes]]:
    data = zstandard.decompress(payload)
    n_columns, n = np.frombuffer(data, dtype="<u4", count=2).tolist()
    at = 8 + 4 * n_columns * n
    columns = []
    for k in range(n_columns):
        lengths = np.frombuffer(data, dtype="<u4", count=n, offset=8 + 4 * k * n)
        ends = (at + np.cumsum(lengths, dtype=np.int64)).tolist()
        columns.append([data[a:b] for a, b in zip([at, *ends], ends)])
        at = ends[-1] if ends else at
    return columns


def _frequent_words(docs: DataFrame, share: float, split: Splitter, n: int) -> list[str]:
    """The ``n`` most frequent words of a sample of whole documents."""
    cut = int(share * (1 << 20)) + 1
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cut)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text"):
                counts.update(split(text.as_py()))
            short = {w: c for w, c in counts.items() if len(w) <= 64}
            yield pa.RecordBatch.from_pydict(
                {"word": list(short), "n": list(short.values())},
                schema=arrow_schema("word string, n long"),
            )

    counted = sample.mapInArrow(count, "word string, n long").groupBy("word")
    top = counted.agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n)
    return [row.word for row in top.collect()]


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    frequent: int = 150_000,
    sample_bytes: int = 32 << 20,
    block_bytes: int = 4 << 20,
    shard_bytes: int = 32 << 20,
) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every row.

    A missing text counts as empty and gives no ids; repeated rows stay repeated; an
    empty table gives no row. ``frequent`` words of about ``sample_bytes`` of text are
    broadcast; a block holds about ``block_bytes`` of text or one longer document.
    """
    context = docs.sparkSession.sparkContext
    docs = document_columns(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = total // block_bytes + 1
    n_shards = total // shard_bytes + 1
    with open(ranks_path, "rb") as file:
        ranks = file.read()
    split = Splitter(pattern)
    words = _frequent_words(docs, min(1.0, sample_bytes / (total + 1)), split, frequent)
    held = {"ranks": ranks, "pattern": pattern}
    known = dict(zip(words, _word_ids([w.encode() for w in words], held)))
    shared = context.broadcast({"ranks": ranks, "pattern": pattern, "known": known})

    blocks = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            packed = [_pack(*held[block]) for block in held]
            out = {"block": list(held), "payload": packed}
            held.clear()
            return pa.RecordBatch.from_pydict(out, schema=arrow_schema(_ANSWER))

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for block, doc_id, text in zip(
                batch.column("block").to_pylist(), names, batch.column("text").cast("binary")
            ):
                ids, texts = held.setdefault(block, ([], []))
                ids.append(b"" if doc_id is None else doc_id.to_bytes(8, "little", signed=True))
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > 16 << 20:
                    yield rows()
                    size = 0
        yield rows()
        give_back()

    dealt = (
        docs.select(blocks.alias("block"), "doc_id", "text")
        .mapInArrow(pack, _ANSWER)
        .repartition(int(n_blocks) // 2 + 1, "block")
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value["known"]
        wanted: dict[int, set] = {}
        held = 0

        def rows() -> pa.RecordBatch:
            out: dict[tuple, list] = {}
            for block, found in wanted.items():
                for word in sorted(found):
                    data = word.encode()
                    out.setdefault((crc32(data) % n_shards, block), []).append(data)
            wanted.clear()
            return pa.RecordBatch.from_pydict(
                {
                    "shard": [shard for shard, _ in out],
                    "block": [block for _, block in out],
                    "payload": [_pack(values) for values in out.values()],
                },
                schema=arrow_schema(_ASK),
            )

        for batch in batches:
            for block, payload in zip(*(c.to_pylist() for c in batch.columns)):
                for text in _unpack(payload)[1]:
                    found = wanted.setdefault(block, set())
                    before = len(found)
                    found.update(set(split(text.decode())).difference(known))
                    held += len(found) - before
                if held > 1 << 17:
                    yield rows()
                    held = 0
        yield rows()
        give_back()

    def answer(asked: pa.Table) -> pa.Table:
        ids: dict[bytes, bytes] = {}
        packed = []
        for payload in asked.column("payload").to_pylist():
            (words,) = _unpack(payload)
            new = [word for word in words if word not in ids]
            ids.update(zip(new, _word_ids(new, shared.value)))
            packed.append(_pack(words, [ids[word] for word in words]))
        return pa.table(
            {"block": asked.column("block"), "payload": pa.array(packed, pa.binary())},
            schema=arrow_schema(_ANSWER),
        )

    def assemble(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids = dict(shared.value["known"])
        for payload in answers.column("payload").to_pylist():
            words, values = _unpack(payload)
            ids.update(zip((word.decode() for word in words), values))
        give_back()
        get = ids.__getitem__
        names, encoded = [], []
        for payload in texts.column("payload").to_pylist():
            for doc_id, text in zip(*_unpack(payload)):
                names.append(int.from_bytes(doc_id, "little", signed=True) if doc_id else None)
                encoded.append(b"".join(map(get, split(text.decode()))))
        return pa.table(
            {"doc_id": pa.array(names, pa.int64()), "ids": pa.array(encoded, pa.binary())}
        )

    answers = (
        dealt.mapInArrow(ask, _ASK)
        .repartition(int(n_shards), "shard")
        .groupBy("shard")
        .applyInArrow(answer, _ANSWER)
    )
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(assemble, "doc_id long, ids binary")
    )


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``bytes``: the tokens of ``ids`` put together.

    The token table has one row per rank, a fixed number for a tokenizer, so it is
    broadcast; missing ids decode to no bytes.
    """
    with open(ranks_path, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast({"ranks": file.read()})
    encoded = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        if "tokens" not in table:
            table["tokens"] = {r: t for t, r in read_ranks(table["ranks"]).items()}
        get = table["tokens"].__getitem__
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                texts = []
                for ids in batch.column("ids"):
                    numbers = np.frombuffer(ids.as_py() or b"", dtype="<u4").tolist()
                    texts.append(b"".join(map(get, numbers)))
                yield batch.append_column("bytes", pa.array(texts, pa.binary()))

    return encoded.mapInArrow(run, "doc_id long, ids binary, bytes binary")


def bpe_report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: number and digest of its ids, digest of the round trip."""
    return decode(encode(docs, ranks_path, pattern), ranks_path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
