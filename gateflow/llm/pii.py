"""Personal data: exact rules, and identifiers found by their context.

The rules find four kinds. Their finds are the seeds of a bootstrap: the two words
before a seed and the word after it make lexical patterns of its kind. Tokens that
look like an identifier of a kind but pass no rule are candidates with the patterns
around them. Spark scores the graph of patterns and instances (values) by turns until
no score moves: an instance is as good as the patterns that hold it, a pattern as good
as the share of its distinct instances that are seeds or good. Good instances bring in
further patterns as seeds do. Candidates whose score ends above the threshold become
spans too, so that an identifier in a form no rule knows is found where the corpus
shows its contexts. Seeds always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import give_back
from gateflow.operators.joins import broadcast_if_small
from gateflow.session import store_table

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield "email", start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    numbers = [int(d) for d in reversed(digits)]
    doubled = (sum(divmod(2 * d, 10)) for d in numbers[1::2])
    return (sum(numbers[::2]) + sum(doubled)) % 10 == 0


def rule_spans(text: str) -> list[Span]:
    """Spans (kind, start, end in code points) by the rules, by kind and then start.

    Each kind takes its leftmost matches that do not overlap; a match that fails its
    test is dropped whole. A text without digits or ``@`` is passed over quickly.
    """
    spans = list(_emails(text))
    if not _DIGIT.search(text):
        return spans
    for match in _IP.finditer(text):
        parts = match.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            spans.append(("ip", *match.span()))
    for match in _CARD.finditer(text):
        if match.end() - match.start() < 16 or match.end() - match.start() > 37:
            continue
        digits = "".join(_DIGIT.findall(match.group()))
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(match.group())) <= 15:
                spans.append(("phone", *match.span()))
    return spans


#: What a value of a kind may look like where no rule takes it.
_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\]|＠)\x20?")
_BEFORE_AT = re.compile(r"[\w.%+-]{1,64}\Z")
_AFTER_AT = re.compile(r"[\w-]{1,64}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\w-]{1,64})+")
_SHAPES = (
    ("ip", ":", re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")),
    ("card", "", re.compile(r"(?<![\w.+-])[0-9](?:[ .\-/]?[0-9]){12,18}(?![\w-])")),
    ("phone", "", re.compile(r"(?<![\w.+-])\(?[0-9](?:[ .()\-/]{0,2}[0-9]){6,14}(?![\w-])")),
)
_HINT = re.compile(r"[0-9@＠]|\(at\)|\[at\]")
_TOKEN = re.compile(r"\S+")
_NUMBER = re.compile(r"[0-9]+")


def _whole(text: str, most: int) -> str:
    """``text``, or its begin and a digest of all of it if it is longer than ``most``."""
    if len(text) <= most:
        return text
    digest = hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
    return f"{text[: most // 2]}…{digest}"


def _patterns(text: str, kind: str, start: int, end: int) -> list[str]:
    """Patterns around a span: two words before it, one before and one after it."""
    left = _TOKEN.findall(text[max(0, start - 80) : start])[-2:]
    right = _TOKEN.findall(text[end : end + 40])[:1]

    def norm(words: list[str]) -> str:
        return _whole(_NUMBER.sub("0", " ".join(words).lower()), 80)

    found = []
    if len(left) == 2:
        found.append(f"{kind} < {norm(left)}")
    if left and right:
        found.append(f"{kind} <> {norm(left[-1:])} … {norm(right)}")
    return found


def _shaped(text: str) -> Iterator[Span]:
    """Leftmost values of each shape; every step looks at a bounded stretch."""
    for match in _AT.finditer(text):
        before = _BEFORE_AT.search(text[max(0, match.start() - 64) : match.start()])
        after = _AFTER_AT.match(text, match.end())
        if before and after:
            yield "email", match.start() - len(before.group()), after.end()
    if _DIGIT.search(text):
        for kind, needed, shape in _SHAPES:
            if needed in text:
                for match in shape.finditer(text):
                    yield kind, *match.span()


def candidate_spans(text: str, taken: list[Span]) -> list[Span]:
    """Spans that look like an identifier and overlap no other span."""
    if not _HINT.search(text):
        return []
    busy: list[list[int]] = []  # apart from each other, in order
    for start, end in sorted((start, end) for _, start, end in taken):
        if busy and start < busy[-1][1]:
            busy[-1][1] = max(end, busy[-1][1])
        else:
            busy.append([start, end])
    found: list[Span] = []
    for kind, start, end in _shaped(text):
        at = bisect_left(busy, [end])
        if at == 0 or busy[at - 1][1] <= start:
            found.append((kind, start, end))
            busy.insert(at, [start, end])
    return found


_SPAN = "struct<kind string, start int, stop int>"
_SEEN = "struct<kind string, start int, stop int, seed boolean, value string, patterns array<string>>"
_ROW = f"doc_id long, row long, base array<{_SPAN}>, seen array<{_SEEN}>"


def _found(docs: DataFrame) -> DataFrame:
    """Spans by the rules, and all identifiers with the patterns around them."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = [("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]
        more = [("seed", pa.bool_()), ("value", pa.string())]
        more.append(("patterns", pa.list_(pa.string())))
        target = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("row", pa.int64()),
                ("base", pa.list_(pa.struct(span))),
                ("seen", pa.list_(pa.struct(span + more))),
            ]
        )
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                bases, seens = [], []
                for text in batch.column("text").to_pylist():
                    base = rule_spans(text)
                    seen = [(s, True) for s in base]
                    seen += [(s, False) for s in candidate_spans(text, base)]
                    bases.append([dict(zip(("kind", "start", "stop"), s)) for s in base])
                    seens.append(
                        [
                            {
                                "kind": kind,
                                "start": start,
                                "stop": stop,
                                "seed": seed,
                                "value": _whole(text[start:stop], 200),
                                "patterns": _patterns(text, kind, start, stop),
                            }
                            for (kind, start, stop), seed in seen
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("row"),
                        pa.array(bases, target.field("base").type),
                        pa.array(seens, target.field("seen").type),
                    ],
                    schema=target,
                )
        give_back()

    return rows.mapInArrow(run, _ROW)


def bootstrap(
    edges: DataFrame,
    rounds: int | None = None,
    least_support: int = 3,
    threshold: float = 0.6,
    epsilon: float = 0.001,
) -> DataFrame:
    """kind, value and score of the candidate instances of a pattern-instance graph.

    ``edges`` has kind, value, seed and pattern. Seeds keep score 1. A pattern's
    score is the mean score of its distinct instances, damped where these are few; an
    instance takes the doubt of its patterns together. Only patterns with
    ``least_support`` distinct seeds, or instances that other patterns lift to
    ``threshold``, can speak for others.

    The scores are the limit of these rounds. A pattern of s seeds and many other
    values nears it slowly, since most of its mean is its own word, so a round solves
    for that word: with v the sum of what other patterns say of its instances, the
    pattern's doubt is 1 / (s + 1 + v). Rounds go on while a score moves by more
    than ``epsilon``; no score ever falls. With ``rounds`` that many plain rounds
    are made instead.
    """
    edges = store_table(
        edges.groupBy("kind", "value", "pattern").agg(F.max("seed").alias("seed"))
    )
    counts = (
        edges.groupBy("pattern")
        .agg(F.count_if("seed").alias("seeds"), F.count_if(~F.col("seed")).alias("others"))
        .filter((F.col("others") > 0) & (F.col("seeds") + F.col("others") >= least_support))
    )
    edges = store_table(edges.filter("NOT seed").join(counts, "pattern").drop("seed"))
    speaking = scores = None
    done = 0
    while rounds is None or done < rounds:
        known = edges.withColumns({"doubt": F.lit(0.0), "own": F.lit(0.0)})
        if scores is not None:
            known = (
                edges.join(scores.select("kind", "value", "doubt"), ["kind", "value"], "left")
                .join(speaking, "pattern", "left")
                .fillna(0.0, ["doubt", "own"])
            )
        known = known.withColumn("apart", 1 - F.exp(F.col("doubt") - F.col("own")))
        patterns = known.groupBy("pattern").agg(
            F.max("seeds").alias("seeds"),
            F.max("others").alias("others"),
            F.sum(1 - F.exp("doubt")).alias("score"),
            F.sum("apart").alias("apart"),
            F.count_if(F.col("apart") >= threshold).alias("accepted"),
        )
        if rounds is None:
            own = -F.ln(F.col("seeds") + 1 + F.col("apart"))
        else:
            trust = (F.col("seeds") + F.col("score")) / (F.col("seeds") + F.col("others") + 1)
            own = F.ln(1 - F.least(trust, F.lit(0.999)))
        useful = F.col("seeds") + F.col("accepted") >= least_support
        speaking = broadcast_if_small(patterns.filter(useful).select("pattern", own.alias("own")))
        before, scores = scores, store_table(
            edges.join(speaking, "pattern")
            .groupBy("kind", "value")
            .agg(F.sum("own").alias("doubt"))
            .withColumn("score", 1 - F.exp("doubt"))
        )
        done += 1
        if rounds is None:
            rise = F.col("score")
            moved = scores
            if before is not None:
                old = before.select("kind", "value", F.col("score").alias("old"))
                moved = scores.join(old, ["kind", "value"], "left")
                rise = F.col("score") - F.coalesce("old", F.lit(0.0))
            if (moved.agg(F.max(rise)).first()[0] or 0) <= epsilon:
                break
    return scores.select("kind", "value", "score")


def find_personal_data(
    docs: DataFrame, rounds: int | None = None, least_support: int = 3, threshold: float = 0.6
) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, stop) of every row.

    ``base`` are the spans by the rules, ``spans`` these and the bootstrapped ones,
    both by kind as listed and then start; code points, stop exclusive. A missing
    text counts as empty and has no spans; repeated rows stay repeated; an empty
    table gives no row. Only identifiers are shuffled, never texts.
    """
    found = store_table(_found(docs))
    seen = found.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    edges = seen.select("kind", "value", "seed", F.explode("patterns").alias("pattern"))
    scores = bootstrap(edges, rounds, least_support, threshold)
    accepted = scores.filter(F.col("score") >= threshold)
    added = (
        seen.filter("NOT seed")
        .join(accepted.select("kind", "value"), ["kind", "value"], "left_semi")
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added"))
    )
    place = f"array_position(array({', '.join(repr(k) for k in KINDS)}), x.kind)"
    both = F.expr(
        f"""transform(array_sort(transform(
                concat(base, coalesce(added, array())),
                x -> struct({place} AS p, x.start AS start, x.stop AS stop, x.kind AS kind))),
            x -> struct(x.kind AS kind, x.start AS start, x.stop AS stop))"""
    )
    return found.join(added, "row", "left").select("doc_id", "row", "base", both.alias("spans"))


def _listed(column: str) -> str:
    return f"array_join(transform({column}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the rules' spans, and all spans."""
    counts = [
        F.expr(f"size(filter(base, x -> x.kind = '{kind}'))").cast("long").alias(f"n_{kind}")
        for kind in KINDS
    ]
    return find_personal_data(docs).select(
        "doc_id",
        *counts,
        F.sha2(F.expr(_listed("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_listed("spans")).alias("spans"),
    )


def redact(docs: DataFrame, rounds: int | None = None, least_support: int = 3) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets.

    Overlapping spans are one span under the kind of the first. Other columns stay;
    ``n_chars``, where there is one, counts the new text.
    """
    rows = store_table(docs.withColumn("__row", F.monotonically_increasing_id()))
    spans = find_personal_data(
        rows.select(F.col("__row").alias("doc_id"), "text"), rounds, least_support
    ).select(F.col("doc_id").alias("__row"), F.expr("array_sort(transform(spans, x -> struct(x.start, x.stop, x.kind)))").alias("__spans"))
    pieces = """
        aggregate(__spans, struct(CAST('' AS STRING) AS done, 0 AS at),
            (a, x) -> IF(x.start < a.at, struct(a.done AS done, greatest(a.at, x.stop) AS at),
                struct(concat(a.done, substring(text, a.at + 1, x.start - a.at), '<', x.kind, '>') AS done,
                       x.stop AS at)),
            a -> concat(a.done, substring(text, a.at + 1)))"""
    spans = broadcast_if_small(spans.filter("size(__spans) > 0"))
    out = rows.join(spans, "__row", "left").withColumn(
        "text", F.expr(f"CASE WHEN __spans IS NULL THEN text ELSE {pieces} END")
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)
