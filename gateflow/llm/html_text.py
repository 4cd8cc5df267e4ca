"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their path of tags from the root. For every path
the text length and the punctuation per node make two ratios; they are smoothed over
neighbouring paths of the page, fused, and compared with a threshold that follows
from the page itself. All blocks on paths above it are taken, and they show where the
content is: the smallest element that holds nearly all of their text is the core, whose
text is taken but for link lists below the threshold, and headlines are taken from the
smallest element that holds all of it. Where the core lies in an article, the article
is the content. Elements that by name, role or class are
no part of an article are left out before, but not those that are forms, or whose class
or id marks them, and that hold most of the text; marked words within a sentence stay.
All data of a page lie in its row, so pages
are worked on where they are read, without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import arrow_schema

_MARKUP = re.compile(
    r"<!--(?P<comment>)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)"
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？¿¡]")

#: Elements of HTML by their role here (fixed values).
_RAW = frozenset("script style noscript template iframe title textarea xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr br img".split()
)
_OUTSIDE = frozenset(
    "nav footer aside script style noscript template iframe button select dialog menu "
    "svg object head title textarea".split()
)
_PARTS = _INLINE | frozenset(
    "p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre figure figcaption table "
    "thead tbody tfoot tr td th caption header".split()
)
_HEADLINES = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_PARAGRAPHS = _HEADLINES | frozenset("p li dt dd td th blockquote pre figcaption caption".split())
#: What a mark leaves of the ratio of a block's path.
_LOWERED = 0.6
_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar "
    "toolbar form".split()
)
#: Words in a class or id that mark what surrounds an article (fixed values).
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs "
    "comment comments consent cookie cookies disqus footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
    "promo promoted promotion recommended related replies reply respond share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: What an opening tag closes when it stands open: p by blocks, items by their like.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_CAMEL = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


class _Element:
    __slots__ = ("tag", "path", "paths", "depth", "parent", "outside", "link", "inside", "mark", "soft", "weight")

    def __init__(self, tag: str, parent: _Element | None, attributes: str):
        self.tag, self.parent, self.weight = tag, parent, 0.0
        #: Numbers of the page's paths, by the number of the path above and the tag.
        self.paths: dict[tuple[int, str], int] = parent.paths if parent else {}
        self.path = self.paths.setdefault((parent.path, tag), len(self.paths) + 1) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent and parent.inside) or tag in ("article", "main")
        self.link = tag == "a" or bool(parent and parent.link)
        own = tag in _OUTSIDE or (tag == "header" and not self.inside)
        # A form may be the frame of a whole page, so it is a mark like a class.
        self.mark = 2 if tag == "form" else 0
        if not own and attributes and tag not in ("html", "body", "article", "main"):
            own = _hidden(attributes)
            self.mark = max(self.mark, _marked(attributes, self.inside))
        #: Marked words within a block, which go only where they are all of it.
        self.soft = tag in _INLINE and bool(self.mark or (parent and parent.soft))
        self.outside = own or bool(parent and parent.outside)


def _hidden(attributes: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and "".join(values).lower() == "true"):
            return True
    return False


def _marked(attributes: str, inside: bool) -> int:
    """2 if a role, or a whole name of a class or id, is a mark; 1 if one is within a name.

    The header of an article holds its headline, so there the word is no mark.
    """
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name in ("class", "id"):
            for token in value.split():
                words = [word.lower() for word in _CAMEL.findall(token)]
                if any(word in _MARKS and not (inside and word == "header") for word in words):
                    found = max(found, 2 if len(words) == 1 else 1)
        elif name == "role" and value.lower() in _ROLES:
            found = 2
    return found


def _unmarked(blocks: list[tuple[_Element, str, int]]) -> list[tuple[_Element, str, int]]:
    """Blocks that lie in no marked element, but for wrappers of the page's content.

    The text that matters is that of the outermost articles, without these of the
    outermost main elements, without these of the page. A marked element with more than
    half of it is a wrapper. Inside an article, or by a whole name on a page that has
    none, it must hold four fifths, as long comments do hold half. In an article a name
    that only mentions a mark drops no paragraph, and no other block of text whose path
    keeps its ratio when the mark lowers it.
    """
    anchors = {"article": 0, "main": 0}
    chains = []
    for element, text, _ in blocks:
        chain = []
        node: _Element | None = element
        while node is not None:
            chain.append(node)
            node = node.parent
        chains.append(chain)
        for tag in anchors:
            if any(node.tag == tag for node in chain):
                anchors[tag] += len(text)
    anchor = next((tag for tag, size in anchors.items() if size), None)
    total = 0
    held: dict[int, int] = {}
    within: set[int] = set()
    for (_, text, _), chain in zip(blocks, chains):
        # Places of the outermost anchor and of what lies below it.
        top = max((k for k, node in enumerate(chain) if node.tag == anchor), default=None)
        if anchor is None or top is not None:
            total += len(text)
            for k, node in enumerate(chain):
                if node.mark:
                    held[id(node)] = held.get(id(node), 0) + len(text)
                    if top is not None and k < top:
                        within.add(id(node))

    def wrapper(node: _Element) -> bool:
        strict = id(node) in within or (anchor is None and node.mark == 2)
        share = held.get(id(node), 0)
        return share >= 0.8 * total if strict else share > 0.5 * total

    scores, threshold = path_scores(blocks), 0.0
    if total:
        threshold = 0.6 * sum(scores[e.path] * len(text) for e, text, _ in blocks) / sum(len(t) for _, t, _ in blocks)

    def text_of_its_own(node: _Element, element: _Element) -> bool:
        if node is not element or not node.inside or node.mark != 1:
            return False
        return node.tag in _PARAGRAPHS or _LOWERED * scores[node.path] >= threshold

    return [
        block
        for block, chain in zip(blocks, chains)
        if all(not n.mark or wrapper(n) or text_of_its_own(n, block[0]) for n in chain)
    ]


def _blocks(page: str) -> list[tuple[_Element, str, int]]:
    """Text blocks in page order: innermost block element, text, characters in links."""
    root = _Element("", None, "")
    stack = [root]
    blocks: list[tuple[_Element, str, int]] = []
    pieces: list[str] = []
    linked = softened = 0

    def close_block() -> None:
        nonlocal linked, softened
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text and softened < sum(len(piece.strip()) for piece in pieces):
                owner = stack[-1]
                while owner.parent is not None and owner.tag in _INLINE:
                    owner = owner.parent
                blocks.append((owner, text, linked))
            pieces.clear()
        linked = softened = 0

    def pop_to(names: set, barrier: set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in barrier:
                return
            if stack[k].tag in names:
                del stack[k:]
                return

    at, n = 0, len(page)
    lower = None
    while at < n:
        match = _MARKUP.search(page, at)
        end = match.start() if match else n
        if end > at and not stack[-1].outside:
            pieces.append(page[at:end])
            if stack[-1].link:
                linked += end - at
            if stack[-1].soft:
                softened += len(page[at:end].strip())
        if match is None:
            break
        at = match.end()
        if match.group("comment") is not None:
            stop = page.find("-->", at)
            at = n if stop < 0 else stop + 3
            continue
        if match.group("tag") is None:
            continue
        tag = match.group("tag").lower()
        if match.group("close"):
            if tag in _INLINE:
                pop_to({tag}, {"table", "td", "th", "li", "div", "article", "p"})
                continue
            close_block()
            if tag != "p" or any(e.tag == "p" for e in stack[-6:]):
                pop_to({tag}, {"table"} if tag in ("p", "li") else set())
            continue
        attributes = match.group("attributes")
        if tag == "br":
            if not stack[-1].outside:
                pieces.append(" ")
            continue
        if tag in _RAW:
            lower = lower or _ascii_lower(page)
            stop = lower.find(f"</{tag}", at)
            stop = n if stop < 0 else lower.find(">", stop)
            at = n if stop < 0 else min(stop + 1, n)
            continue
        if tag not in _INLINE:
            close_block()
            pop_to({"p"}, {"table", "button", "object"})
            if tag in _CLOSES:
                pop_to(*_CLOSES[tag])
        if tag not in _VOID and not attributes.endswith("/"):
            stack.append(_Element(tag, stack[-1], attributes))
    close_block()
    return blocks


def _ascii_lower(text: str) -> str:
    """Lower case that keeps every place in the text."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else re.sub("[A-Z]", lambda m: m.group().lower(), text)


def path_scores(blocks: list[tuple[_Element, str, int]]) -> dict[int, float]:
    """Fused and smoothed ratio of every tag path, in order of appearance."""
    sums: dict[int, list[float]] = {}
    for element, text, _ in blocks:
        own = sums.setdefault(element.path, [0, 0, 0])
        own[0] += len(text)
        own[1] += len(_PUNCTUATION.findall(text))
        own[2] += 1
    paths = list(sums)
    fused = [
        math.log1p(chars / nodes) * (1 + math.log1p(marks / nodes))
        for chars, marks, nodes in sums.values()
    ]
    kernel = (0.1, 0.8, 0.1)
    smooth = {}
    for i, path in enumerate(paths):
        parts = [(k, i + j - 1) for j, k in enumerate(kernel) if 0 <= i + j - 1 < len(paths)]
        smooth[path] = sum(k * fused[j] for k, j in parts) / sum(k for k, _ in parts)
    return smooth


def main_text(page: str, share: float = 0.9) -> str:
    """The main text of a page; blocks are joined by a line feed.

    Empty or missing pages and pages without text outside menus and the like give an
    empty text.
    """
    blocks = _unmarked(_blocks(page))
    if not blocks:
        return ""
    scores = path_scores(blocks)
    weights = {path: 0 for path in scores}
    for element, text, _ in blocks:
        weights[element.path] += len(text)
    total = sum(weights.values())
    # The threshold lies under the mean ratio of a character of the page.
    threshold = 0.6 * sum(scores[path] * w for path, w in weights.items()) / total
    chosen = 0
    for element, text, _ in blocks:
        if scores[element.path] >= threshold:
            chosen += len(text)
            node: _Element | None = element
            while node is not None:
                node.weight += len(text)
                node = node.parent
    # The core: the deepest element that still holds nearly all chosen text. The whole:
    # the deepest that holds all of it.
    core, whole = (
        max((e for e in _elements(blocks) if e.weight >= least), key=lambda e: e.depth)
        for least in (share * chosen, chosen)
    )
    # A paragraph or a list is a part of content, and an article is whole.
    core, whole = _lifted(core), _lifted(whole)
    article = None
    node = core
    while node is not None:
        if node.tag in ("article", "main"):
            article = node
        node = node.parent
    if article is not None:
        core = whole = article
    kept = []
    for element, text, linked in blocks:
        passes = scores[element.path] >= threshold
        listed = linked >= 0.8 * len(text) and not passes
        # Beside the core stand what passes and the headlines.
        if _within(element, core):
            take = not listed
        elif article is None:
            take = passes or (element.tag in _HEADLINES and not listed and _within(element, whole))
        else:
            take = False
        if take:
            kept.append(text)
    return "\n".join(kept)


def _lifted(element: _Element) -> _Element:
    while element.parent is not None and element.tag in _PARTS:
        element = element.parent
    return element


def _within(element: _Element, other: _Element) -> bool:
    node: _Element | None = element
    while node is not None and node is not other:
        node = node.parent
    return node is not None


def _elements(blocks: list[tuple[_Element, str, int]]) -> list[_Element]:
    """All elements that hold text, the root first, then in page order."""
    seen: dict[int, _Element] = {}
    for element, _, _ in blocks:
        chain = []
        node: _Element | None = element
        while node is not None and id(node) not in seen:
            chain.append(node)
            node = node.parent
        for node in reversed(chain):
            seen[id(node)] = node
    return list(seen.values())


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row; a missing html counts as empty."""
    schema = "page_id long, url string, text string"
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                texts = [main_text(page) for page in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                    schema=arrow_schema(schema),
                )

    return rows.mapInArrow(run, schema)


def pages_report(pages: DataFrame) -> DataFrame:
    """One row per page: its main text and the number of code points."""
    return extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))
