"""Main text of pages, made and given."""

import re

import pytest

from gateflow.llm.html_text import extract_pages, main_text, pages_report

PROSE = "A long sentence, with commas and a stop, tells a story. And another one follows it, too."


def page(body, head="<title>T</title><script>if (a < b) { x('</p>') }</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_without_what_surrounds_it():
    html = page(
        '<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, ok?</div>'
        '<header>Site</header><div class="ad">Buy it!</div>'
        f"<article><h1>Title &amp; more</h1><p>{PROSE}<p>{PROSE} <b>Bold</b>\n  text&nbsp;here."
        "<form>Name <input name=x></form><aside>Aside, of course.</aside>"
        f"<ul><li>First item, it is.</li><li>Second item.</li></ul><style>p {{}}</style><!-- {PROSE} -->"
        '<div class="comments"><p>Nice post, thank you.</p></div></article>'
        '<div id="sidebar"><p>More, more, more.</p></div><footer>&copy; me</footer>'
    )
    assert main_text(html) == "\n".join(
        ["Title & more", PROSE, f"{PROSE} Bold text here.", "First item, it is.", "Second item."]
    )


def test_content_without_an_article_element():
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(9))
    html = page(f"<div><ul>{links}</ul></div><div><h2>Head</h2><p>{PROSE}</p><p>{PROSE}</p></div>")
    assert main_text(html) == f"Head\n{PROSE}\n{PROSE}"


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("<p>", ""),
        ("plain  words", "plain words"),
        ("<p>cut &am", "cut &am"),
        ("<p>a &lt; b</p><p>1 < 2 &#233; &eacute;</p>", "a < b\n1 < 2 é é"),
        ("<p>one<br>two<p", "one two"),
        ("<script>never closed <p>text", ""),
        ("<p>x<!-- never closed <p>y", "x"),
        ('<p title="a > b">quoted</p>', "quoted"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ],
)
def test_odd_markup(html, text):
    assert main_text(html) == text


def test_deep_and_long_pages_end():
    assert main_text("<div>" * 3000 + "deep, very deep." + "</div>" * 3000) == "deep, very deep."
    long = "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"
    assert main_text(long).count("\n") == 4999


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in pages_report(pages).collect()}
    assert len(rows) == pages.count()
    import html as entities

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", inner)
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in parts]
        assert rows[r.page_id].text == "\n".join(p for p in parts if p)
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text)


def test_missing_and_repeated_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract_pages(pages).collect()), key=str)
    assert got == [(1, "u", ""), (1, "u", ""), (None, None, "a")]
    assert pages_report(pages.limit(0)).count() == 0


def sentences(word, n):
    return " ".join(f"The {word} number {i} was seen, heard and noted by all." for i in range(n))


def test_content_beside_the_largest_element_without_an_article():
    lead, body = sentences("lead", 4), [sentences(f"part{i}", 8) for i in range(6)]
    paragraphs = "".join(f"<p>{t}</p>" for t in body)
    page = (
        "<html><body><div class=wrap><h1>A headline</h1><div class=lead><p>" + lead + "</p></div>"
        f"<div class=body>{paragraphs}</div></div>"
        "<div><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></div></body></html>"
    )
    assert main_text(page).split("\n") == ["A headline", lead, *body]


def test_deep_paths_are_told_apart():
    deep = "<section>" * 60
    text = [sentences(f"part{i}", 6) for i in range(5)]
    links = "".join(f"<li><p><a href=x>Link {i}</a></p></li>" for i in range(5))
    page = f"<body>{deep}<div>" + "".join(f"<p>{t}</p>" for t in text) + f"<ul>{links}</ul></div>"
    assert main_text(page).split("\n") == text


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "with-comments", "site-header-fixed"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrapper_that_mentions_a_mark(name, tag):
    text = [sentences(f"part{i}", 5) for i in range(4)]
    paragraphs = "".join(f"<p>{t}</p>" for t in text)
    around = "<div class=sidebar><p>" + sentences("aside", 2) + "</p></div>"
    body = f'<div class="{name}"><{tag}>{paragraphs}</{tag}>{around}</div>'
    assert main_text(page(body)).split("\n") == text


@pytest.mark.parametrize("tag", ["div", "header"])
def test_wrapper_of_the_headline_in_an_article(tag):
    text = sentences("part", 9)
    comments = "<section class='comments-area'><article class=comment><p>" + sentences("reply", 3) + "</p></article></section>"
    body = f'<article><{tag} class="entry-header"><h1>A headline</h1></{tag}><p>{text}</p>{comments}</article>'
    assert main_text(page(body)) == f"A headline\n{text}"


def test_wrapper_names_still_drop_long_comments():
    text, comments = sentences("part", 5), sentences("reply", 12)
    body = f"<div class=post><article><p>{text}</p></article></div><div id=comments><p>{comments}</p></div>"
    assert main_text(page(body)) == text
    body = f"<div class=post><p>{text}</p></div><div id=comments><p>{text}</p></div>"
    assert main_text(page(body)) == text


@pytest.mark.parametrize("frame", ["<form id=aspnetForm>{}</form>", "<form><article>{}</article></form>", "<article><form>{}</form></article>"])
def test_form_around_the_page(frame):
    text = [sentences(f"part{i}", 5) for i in range(4)]
    body = frame.format("".join(f"<p>{t}</p>" for t in text))
    assert main_text(page("<nav><a href=x>Home</a></nav>" + body)).split("\n") == text


@pytest.mark.parametrize(
    "attributes", ['data-title="the hidden garden"', 'class="lead hidden x"', "data-hidden=1", 'title="hidden"']
)
def test_values_that_mention_hidden(attributes):
    text = [sentences(f"part{i}", 5) for i in range(4)]
    body = f"<article><div {attributes}><p>{text[0]}</p></div>" + "".join(f"<p>{t}</p>" for t in text[1:]) + "</article>"
    assert main_text(page(body)).split("\n") == text
    body = body.replace(attributes, "hidden", 1)
    assert main_text(page(body)).split("\n") == text[1:]


@pytest.mark.parametrize("block", ["<p class='notice-period'>{}</p>", "<div class='share-price'>{}</div>", "<li class=menu-item>{}</li>"])
def test_names_that_mention_a_mark_in_an_article(block):
    text = [sentences(f"part{i}", 5) for i in range(4)]
    body = f"<article><p>{text[0]}</p>{block.format(text[1])}<p>{text[2]}</p><p>{text[3]}</p></article>"
    assert main_text(page(body)).split("\n") == text
    body = f"<article><p>{text[0]}</p><div class=share-buttons>Share</div><div class=ad-box><p>Buy, now!</p></div></article>"
    assert main_text(page(body)) == text[0]


def test_marked_words_within_a_sentence():
    body = f"<article><p>{PROSE}</p><p>He said that <em class=notice>the word</em> matters.</p><p><span class=ad>Buy <b>now</b>!</span></p></article>"
    assert main_text(page(body)) == f"{PROSE}\nHe said that the word matters."
