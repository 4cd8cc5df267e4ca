"""Encoding against the tokenizer library, and the exact round trip."""

import base64
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gateflow.llm.bpe import Splitter, bpe_report, decode, encode

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string"


def library():
    lines = open(PATH, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \n\t'sé²ªº\x1c\x85\xa0中1٣ⅷ_"))))
def test_words_are_those_of_the_pattern(text):
    words = Splitter(PATTERN)(text)
    assert "".join(words) == text
    general = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
    assert words == general.findall(text)


def texts():
    rng = random.Random(5)
    made = ["", None, " ", "a", "Hello  world's\n\n 12 345 é中文 \x1c x", "x" * 3000, "ab " * 4000, "\x00\x01 ‰", "don't we'll"]
    letters = "abcdeéß 1.\n中²"
    return made + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(60)]


def test_ids_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "a"), (None, "b c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    encoding = library()
    want = sorted((str(i), encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    for sizes in ({}, {"frequent": 0, "block_bytes": 300, "shard_bytes": 500}):
        done = decode(encode(docs, PATH, PATTERN, **sizes), PATH).collect()
        got = sorted((str(r.doc_id), np.frombuffer(r.ids, dtype="<u4").tolist(), bytes(r.bytes)) for r in done)
        assert got == want


def test_report_of_all_documents(spark):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoding = library()
    want = set()
    for r in docs.collect():
        ids = encoding.encode_ordinary(r.text or "")
        packed = np.array(ids, dtype="<u4").tobytes()
        want.add((r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert set(map(tuple, bpe_report(docs, PATH, PATTERN).collect())) == want


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe_report(empty, PATH, PATTERN).count() == 0
    clash = spark.createDataFrame([(1, "a", 9, "z")], "doc_id long, text string, block long, ids string")
    assert bpe_report(clash, PATH, PATTERN).first().n_tokens == 1
