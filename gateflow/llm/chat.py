"""Conversations as training windows under a token budget.

Turns are rendered by a template of three markers. Prefix sums of the turns' tokens
choose the windows: a window takes whole turns as long as they fit the budget, begins
with the system turn of the conversation, and repeats as many of the turns just
before it as fit the history budget. The loss mask covers what assistants say in the
new turns alone, so a repeated answer is no target twice.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>\n", "<|end|>\n"

#: Openings of control strings: those of the template and of other common ones.
_CONTROL = r"\||/?s>|/?INST\]|<SYS>>|</SYS>>"
_OPENING = r"(<|\[)"


def escape(text: Column) -> Column:
    r"""Break control strings by a backslash behind their first character.

    Where the text has n backslashes at that place there are n + 1 afterwards, so
    every text comes back.
    """
    return F.regexp_replace(text, rf"{_OPENING}(\\*)(?={_CONTROL})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_OPENING}(\\*)\\(?={_CONTROL})", "$1$2")


def turn_tokens(text: Column, overhead: int = 4) -> Column:
    """Words and single signs of a text, and what the template adds."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]")) + overhead


def _turns(conversations: DataFrame, history: int) -> DataFrame:
    """Turns with their place, rendered text, tokens, and the history before them."""
    filled = {name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text")}
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        filled["role"].alias("role"),
        filled["text"].alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("lead", (F.col("place") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("tokens", turn_tokens(F.col("text")).cast("long"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    rows = rows.withColumn("body", escape(F.col("text")))
    spoken = Window.partitionBy("conv_id", "lead").orderBy("place")
    rows = rows.withColumn("before", F.sum("tokens").over(spoken) - F.col("tokens"))
    # Turns whose prefix sums lie within the history budget before this turn.
    reach = Window.partitionBy("conv_id", "lead").orderBy("before").rangeBetween(-history, -1)
    return rows.select(
        "conv_id",
        "place",
        "lead",
        "tokens",
        "before",
        F.count("*").over(reach).cast("int").alias("n_history"),
        (F.col("before") - F.coalesce(F.min("before").over(reach), F.col("before"))).alias("history"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        F.length("head").alias("n_head"),
        F.length("body").alias("n_body"),
        (F.col("role") == "assistant").alias("target"),
    )


def format_conversations(
    conversations: DataFrame, budget: int = 2048, history: int = 512
) -> DataFrame:
    """Windows of every conversation: conv_id, window, n_context, tokens, text, loss.

    ``n_context`` leading turns of a window are no new ones (the system turn and
    history); ``loss`` holds spans (start, stop) in code points of ``text``. History is
    shortened to what the budget leaves beside the system turn and the first new turn, so
    a window exceeds the budget only if these two do; turns are never cut. Turns that
    share a number are ordered by role and text, repeated rows are turns of their own;
    a missing role or text is empty, rows without a conv_id are one conversation, and
    an empty table gives no window. A conversation is gathered in one row, as one
    document of the corpus; nothing else is.
    """
    fields = ("place", "lead", "tokens", "before", "piece", "n_head", "n_body", "target", "n_history", "history")
    whole = (
        _turns(conversations, history)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("turns"))
        .selectExpr(
            "conv_id",
            "filter(turns, t -> t.lead) AS lead",
            "filter(turns, t -> NOT t.lead) AS said",
        )
        .withColumn("base", F.expr("CAST(aggregate(lead, 0L, (a, t) -> a + t.tokens) AS BIGINT)"))
    )
    # History that fits beside the system turn and the turn itself: of the turns within
    # reach those from which on the prefix sums leave room for both.
    room = f"greatest(0L, least({history}L, {budget} - base - t.tokens))"
    fitting = f"""
        transform(said, (t, i) -> IF(t.history <= {room}, t, named_struct(
            {", ".join(f"'{f}', t.{f}" for f in fields if f not in ("n_history", "history"))},
            'n_history', size(filter(slice(said, i + 1 - t.n_history, t.n_history),
                                     x -> t.before - x.before <= {room})),
            'history', coalesce(array_max(transform(
                filter(slice(said, i + 1 - t.n_history, t.n_history),
                       x -> t.before - x.before <= {room}),
                x -> t.before - x.before)), 0L))))"""
    whole = whole.withColumn("said", F.expr(fitting))
    # Places (from 0) at which windows begin; the last field counts turns.
    begins = f"""
        aggregate(said, struct(array(0) AS begins, base AS used, 0 AS n),
            (a, t) -> IF(a.used + t.tokens > {budget} AND a.n > element_at(a.begins, -1),
                struct(concat(a.begins, array(a.n)) AS begins, base + t.history + t.tokens AS used, a.n + 1 AS n),
                struct(a.begins AS begins, a.used + t.tokens AS used, a.n + 1 AS n)),
            a -> a.begins)"""
    windows = whole.withColumn("begins", F.expr(begins)).select(
        "conv_id", "lead", "said", "begins", F.posexplode("begins").alias("window", "begin")
    )
    windows = windows.withColumn(
        "n_history", F.expr("IF(window = 0, 0, said[begin].n_history)")
    ).withColumn("end", F.expr("coalesce(get(begins, window + 1), size(said))"))
    windows = windows.withColumn(
        "held", F.expr("concat(lead, slice(said, begin - n_history + 1, end - begin + n_history))")
    ).withColumn("n_context", F.expr("IF(window = 0, 0, size(lead)) + n_history"))
    spans = """
        aggregate(held, struct(0 AS at, 0 AS n, CAST(array() AS ARRAY<STRUCT<start: INT, stop: INT>>) AS spans),
            (a, t) -> struct(a.at + length(t.piece) AS at, a.n + 1 AS n,
                IF(t.target AND a.n >= n_context AND t.n_body > 0,
                   concat(a.spans, array(struct(a.at + t.n_head AS start, a.at + t.n_head + t.n_body AS stop))),
                   a.spans) AS spans),
            a -> a.spans)"""
    return windows.select(
        "conv_id",
        "window",
        "n_context",
        F.expr("aggregate(held, 0L, (a, t) -> a + t.tokens)").alias("tokens"),
        F.expr("array_join(transform(held, t -> t.piece), '')").alias("text"),
        F.expr(spans).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and targets of each conversation, from the formatted windows alone."""
    pieces = windows.withColumn(
        "pieces", F.split("text", r"<\|end\|>\n")
    ).withColumn("fresh", F.expr("slice(pieces, n_context + 1, size(pieces) - 1 - n_context)"))

    def plain(piece: Column) -> Column:
        rest = F.substring(piece, F.lit(len(TURN) + 1), F.length(piece))
        parts = F.split(rest, r"<\|text\|>\n", 2)
        return F.concat(unescape(parts[0]), F.lit("\n"), unescape(parts[1]), F.lit("\n"))

    def covered(span: Column) -> Column:
        return unescape(F.substring(F.col("text"), span["start"] + 1, span["stop"] - span["start"]))

    read = pieces.select(
        "conv_id",
        "window",
        F.size("fresh").cast("long").alias("n"),
        F.array_join(F.transform("fresh", plain), "").alias("turns"),
        F.array_join(F.transform("loss", covered), "").alias("targets"),
        F.length("text").cast("long").alias("chars"),
    )
    joined = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"),
    )
    return joined.select(
        "conv_id",
        "n_turns",
        F.array_join("w.turns", "").alias("turns"),
        F.array_join("w.targets", "").alias("targets"),
        "formatted_chars",
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from the windows: turns, targets, lengths.

    Conversation -7 is added, whose texts hold control strings.
    """
    probe = "</s>[INST] ok [/INST]"
    added = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", probe), (-7, 1, "assistant", probe)],
        "conv_id long, turn long, role string, text string",
    )
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    return read_back(format_conversations(rows.unionAll(added))).select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2(F.col("targets").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
