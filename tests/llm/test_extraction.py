"""HTML extraction: blocks, the tree, and whole pages."""

import numpy as np
import pytest

from terrane.llm import extraction

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="page comments-on">
<header><a href="/">Site</a> name</header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- ad 3 <p>no</p> -->
<div class="ad">Buy this very fine thing today and get another one</div>
<article><header><h1>A  head&shy;line &lt;1&gt;</h1></header><p><b>First   paragraph<br>goes&nbsp;on &amp;&copy; here.<p>De.</p><p title="a > b">With a <a href="x">link</a> in it.</p>
<form><label>Name</label><button>Send</button></form><section class="comments"><p>I disagree with all of this, said a reader at length.</p></section></article>
<aside><p>Some text that stands beside the article and is long enough to look like one.</p></aside><div class="cookie-notice">We use cookies.</div>
<footer>&copy; 2024 somebody</footer></body></html>"""
TEXT = "A head\u00adline <1>\nFirst paragraph goes on &© here.\nDe.\nWith a link in it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, TEXT), (None, ""), ("", ""), ("<p>", ""), ("just text without any tag at all, but a sentence", "just text without any tag at all, but a sentence"),
        (PAGE[: PAGE.index("</article>")], TEXT), ("<article><p>cut off &am", "cut off &am"), ("<article><p>one < two & three</p><p", "one < two & three"),
        ("<article><p>a<script>x</p>", "a"), ("<nav>a b</nav><!-- open", ""), ("<article><a href=\"x>y</a> z</article>", "y z"),
    ],
)
def test_main_text(page, text):
    assert extraction.main_text(page, extraction.classifier()) == text


def test_soup_without_landmarks():
    menu = "".join(f'<div><a href="/{k}">Item {k}</a></div>' for k in range(6))
    body = "".join(f"<div>{'word ' * 40}{k}.</div>" for k in range(4))
    text = extraction.main_text(f"<body>{menu}<h2>The title of it</h2>{body}{menu}</body>", extraction.classifier())
    assert text.split("\n")[0] == "The title of it" and len(text.split("\n")) == 5


def test_held_out_accuracy():
    pages = extraction.labelled()
    right = total = 0
    for k, (rows, labels) in enumerate(pages):
        rest = [p for j, p in enumerate(pages) if j != k]
        tree = extraction.train(np.concatenate([x for x, _ in rest]), np.concatenate([y for _, y in rest]))
        right += int((tree.predict(rows) == labels).sum())
        total += len(labels)
    assert right / total >= 0.9


def paragraphs(*sizes):
    return [" ".join(f"{name}{k}" for k in range(n)) for name, n in zip("abcdefg", sizes, strict=False)]


@pytest.mark.parametrize("sizes", [(60, 60, 60), (30, 9), (15, 200, 12), (45, 8, 100, 25)])
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<article>{}", "<nav><a>One</a></nav><main>{}</main></body>", "<article>{}</article><footer>Somebody wrote it</footer>"])
def test_page_ends_inside_the_article(sizes, shell):
    own = paragraphs(*sizes)
    page = shell.format("<h1>one two three four five</h1>" + "".join(f"<p>{x}</p>" for x in own))
    assert extraction.main_text(page, extraction.classifier()).split("\n") == ["one two three four five", *own]


@pytest.mark.parametrize("around", ["modal", "social page", "notice", "comments"])
@pytest.mark.parametrize("name", ["article", "main", 'div role="main"'])
def test_names_around_the_article(around, name):
    own, said = paragraphs(60, 60), "<p>" + "said " * 40 + "</p>"
    inside = "<h1>one two three four five</h1>" + "".join(f"<p>{x}</p>" for x in own)
    whole = f'<div class="{around}"><div><{name}>{inside}<div class="comments">{said}</div></{name.split()[0]}></div></div><footer>Somebody</footer>'
    tree = extraction.classifier()
    assert extraction.main_text(whole, tree).split("\n") == ["one two three four five", *own]
    beside = f'<article>{inside}</article><div class="comments"><article>{said}</article><article>{said}</article></div><footer>Somebody</footer>'
    assert extraction.main_text(beside, tree).split("\n") == ["one two three four five", *own]
    hidden = f'<div hidden><{name}>{inside}</{name.split()[0]}></div><footer>Somebody</footer>'
    assert extraction.main_text(hidden, tree) == ""


def test_rows(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extraction.extract(frame, keep=["page_id", "url", "text"]).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, TEXT), (1, TEXT), (2, "")]
    assert extraction.extract(frame.limit(0)).count() == 0


def test_long_page():
    page = "<article>" + "<p>some words of text</p>" * 20000 + "</article>" + "<div" * 20000
    assert extraction.main_text(page, extraction.classifier()).count("\n") == 19999
