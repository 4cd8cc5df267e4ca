"""Windows against a plain greedy packing, and the way back from them."""

import hashlib
import random
import re

from gateflow.llm.chat import chat_report, escape, format_conversations, read_back, unescape
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["<|turn|>", "<|text|>\n", "<|end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "[", "|", "word ", "é😀"]


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for conv in range(30):
        n = rng.choice([1, 2, 5, 40])
        for turn in range(n):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            text = "".join(rng.choice(CONTROL) for _ in range(rng.randrange(25)))
            out.append((conv, turn, role, text))
    return out


def tokens(text):
    import regex

    return len(regex.findall(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]", text)) + 4


def plain_windows(turns, budget, history):
    """(number of repeated turns, number of new turns) of each window."""
    lead = 1 if turns and turns[0][1] == "system" else 0
    base = sum(tokens(t[2]) for t in turns[:lead])
    sizes = [tokens(t[2]) for t in turns[lead:]]
    windows, at = [], 0
    while at < len(sizes) or not windows:
        back = at
        if windows:
            room = min(history, budget - base - sizes[at])
            while back > 0 and sum(sizes[back - 1 : at]) <= room:
                back -= 1
        used, end = base + sum(sizes[back:at]), at
        while end < len(sizes) and (end == at or used + sizes[end] <= budget):
            used += sizes[end]
            end += 1
        windows.append(((lead if windows else 0) + at - back, end - at, used))
        at = end
    return windows


def test_escape_comes_back(spark):
    rng = random.Random(2)
    texts = [("".join(rng.choice(CONTROL) for _ in range(rng.randrange(30))),) for _ in range(500)]
    df = spark.createDataFrame(texts, "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", r.e)


def test_windows_are_greedy_and_within_budget(spark):
    data = rows()
    for budget, history in ((60, 20), (200, 0), (5, 5)):
        got = {}
        for w in format_conversations(spark.createDataFrame(data, SCHEMA), budget, history).collect():
            n = w.text.count("<|end|>\n")
            got.setdefault(w.conv_id, []).append((w.window, w.n_context, n - w.n_context, w.tokens))
        for conv in {r[0] for r in data}:
            turns = [r[1:] for r in sorted(data) if r[0] == conv]
            windows = plain_windows(turns, budget, history)
            lead = turns[0][1] == "system"
            want = [
                (i, c, n + (1 if lead and i == 0 else 0), used) for i, (c, n, used) in enumerate(windows)
            ]
            assert sorted(got[conv]) == want


def test_no_window_exceeds_a_budget_that_its_new_turn_fits(spark):
    rng = random.Random(8)
    data = [
        (conv, turn, "system" if turn == 0 and conv % 2 else "user", "word " * rng.choice([1, 5, 20, 60, 90]))
        for conv in range(40)
        for turn in range(rng.randint(1, 25))
    ]
    tokens_of = {(c, t): tokens(x) for c, t, _, x in data}
    lead = {c: tokens(x) for c, t, r, x in data if r == "system"}
    for w in format_conversations(spark.createDataFrame(data, SCHEMA), 100, 70).collect():
        n = w.text.count("<|end|>\n") - w.n_context - (w.window == 0 and w.conv_id in lead)
        alone = max(size for (c, _), size in tokens_of.items() if c == w.conv_id)
        assert w.tokens <= 100 or (n == 1 and w.tokens <= lead.get(w.conv_id, 0) + alone)
        if lead.get(w.conv_id, 0) + alone <= 100:
            assert w.tokens <= 100


def test_read_back_at_any_budget(spark):
    data = rows(4) + [(99, 0, None, None), (99, 0, "assistant", "twice"), (99, 0, "assistant", "twice"), (None, 1, "ro\nle", "x")]
    df = spark.createDataFrame(data, SCHEMA)
    for budget, history in ((30, 10), (10000, 100)):
        got = {r.conv_id: r for r in read_back(format_conversations(df, budget, history)).collect()}
        for conv in {r[0] for r in data}:
            turns = sorted((t, r or "", x or "") for c, t, r, x in data if c == conv)
            assert got[conv].n_turns == len(turns)
            assert got[conv].turns == "".join(f"{r}\n{x}\n" for _, r, x in turns)
            assert got[conv].targets == "".join(x for _, r, x in turns if r == "assistant")


def test_report_of_all_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = {r.conv_id: r for r in chat_report(table).collect()}
    probe = "</s>[INST] ok [/INST]"
    assert got[-7].loss_chars == len(probe)
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
    assert len(got) == table.select("conv_id").distinct().count() + 1
    clash = spark.createDataFrame([(1, 0, "user", "a", 5, 6)], SCHEMA + ", window long, lead long")
    assert chat_report(clash).count() == 2
    assert chat_report(table.limit(0)).count() == 1


def test_no_python_in_the_plan(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = chat_report(table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
