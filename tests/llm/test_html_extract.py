"""HTML extraction: pages with known main text, and the cut against trying every labelling."""

import itertools
import random

import pytest

from basketlens.llm import html_extract as hx

P1 = "The harbour was quiet when the last of the boats came in that evening, and nobody spoke."
P2 = "Later the keeper wrote down what had happened, line by line, and locked the book away."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x:"</p>"}}</style><script>if (a<b) document.write("<p>no</p>")</script></head>
<body><header><a href="/">Site</a></header><nav><ul><li><a href=/a>A</a></li><li>B</ul></nav><div class="cookie-notice"><p>We use cookies on this site, please agree to all of them now.</p></div>
<article><header><h1>A  title &amp; more</h1></header><p>{P1}<br>Next&nbsp;line &lt;b&gt;
<p>Ok.<div class="ad">Buy this wonderful thing today for little money, only here.</div><p>{P2} <b>Bo<i>ld</i></b><form><input>Your name please, dear reader of this page</form>
<!-- <p>hidden</p> --><ul><li>one item<li>two items</ul><section id="comments"><h2>Comments</h2><p>I have read this with great pleasure, and would like more of it.</p></section></article>
<aside><p>Other stories that you may like to read on this site today.</p></aside><footer>&copy; us, all rights reserved everywhere.</footer></body></html>"""


def test_main_text():
    assert hx.main_blocks(PAGE) == ["A title & more", f"{P1} Next line <b>", "Ok.", f"{P2} Bold", "one item", "two items"]


def test_without_article_element():
    page = f'<body><div id="menu"><a href=x>Home</a> <a href=y>News</a></div><div><h2>Heading of it</h2><p>{P1}</p><p>Short one.</p><p>{P2}</p></div><div><a href=1>Link one to somewhere</a></div><div class="footer">Imprint</div>'
    assert hx.main_blocks(page) == ["Heading of it", P1, "Short one.", P2]


def test_marks_of_a_whole_page_are_not_its_parts():
    page = f'<body class="has-sidebar"><div class="with-sidebar no-ads"><div id="pageHeader">Site name</div><div class="entry"><div class="entry-header"><h1>Title here</h1></div><p>{P1}</p></div><div class="side sidebar-right"><p>{P2}</p></div></div>'
    assert hx.main_blocks(page) == ["Title here", P1]


MENU = '<ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta and more</a></li></ul>'
BODY = f"<h1>Heading</h1><p>{P1}</p><p>Short.</p><p>{P2}</p>"


@pytest.mark.parametrize("page", [
    f"<body><form action=x>{MENU}{BODY}<input type=submit></form></body>",
    f'<body><div class="menu-open page-wrap">{MENU}{BODY}</div></body>',
    f'<body><div class="layout-sidebar-right"><nav>{MENU}</nav>{BODY}<footer>Imprint of all of it.</footer></div></body>',
    f"<body>{MENU}<svg width=1 />{BODY}</body>",
    f"<body>{MENU}<button>{BODY}</body>",
    f"<body>{MENU}<iframe src=x>{BODY}</body>",
    f"<body>{MENU}<BUTTON>Go</BUTTON><button>{BODY}<button>Send it now</button></body>",
    f"<body>{MENU}<svg><svg><text>no</text></svg><text>nor this</text></svg>{BODY}</body>",
    f'<body><form><div class="comment-open">{BODY}</div><div class="ad"><p>Buy this, it is cheap today.</p></div></form></body>',
])
def test_marks_around_a_whole_page(page):
    assert hx.main_blocks(page) == ["Heading", P1, "Short.", P2]


def test_marked_parts_may_be_longer_than_the_article():
    comments = "".join(f"<p>{P2} {P1} {k}</p>" for k in range(20))
    for page in (f'<article>{BODY}<div class="comments">{comments}</div></article>', f'<body>{BODY}<section id="comments">{comments}</section>',
                 f'<div class="menu-open">{BODY}<section id="comments">{comments}</section></div>'):
        assert hx.main_blocks(page) == ["Heading", P1, "Short.", P2]


def test_the_cut_overrules_costs():
    """Blocks whose own cost is on the wrong side, put right by their neighbours."""
    page = f"<body>{MENU}<div><h2>A</h2><p>{P1}</p><p>So.</p><p>{P2}</p><p>No</p><p>{P1} Again.</p></div></body>"
    rows = hx.labelled(page)
    assert [b.text for b, odds, kept in rows if kept and odds < 0] == ["A", "So.", "No"]
    assert [b.text for b, odds, kept in rows if not kept] == ["Alpha", "Beta and more"]
    page = f"<body><div>{BODY}</div><div>" + "".join(f"<p><a href=x>Read on {k}</a></p>" + "<p>More about it here.</p>" * (k == 2) for k in range(6)) + "</div></body>"
    rows = hx.labelled(page)
    assert [b.text for b, odds, kept in rows if not kept and odds > 0] == ["More about it here."]


def test_results_do_not_rest_on_names(sf_small):
    import re

    import pyarrow.parquet as pq
    pages = [p for p in pq.read_table(f"{sf_small}/pages.parquet").column("html").to_pylist() if p]
    for p in pages:
        assert hx.main_blocks(re.sub(r'\b(class|id|role)="[^"]*"', r'\1="qwx"', p)) == hx.main_blocks(p)


def test_elements_without_ends_take_linear_time():
    for tag in ("svg", "button", "object", "iframe", "form", "div class=ad"):
        assert hx.main_blocks(f"<{tag}>" * 4000 + f"<h1>Heading</h1><p>{P1}</p><p>{P2}</p>") == ["Heading", P1, P2]


@pytest.mark.parametrize("page", ["", " ", "<", "<<<>>>", "<p", "<script>never closed <p>x", "<!-- open", "<a href='x", "</div></div>", "&#xZZ;&#0;", "<div " + "a='" * 50, "<p>" * 3000])
def test_broken_pages_do_not_crash(page):
    hx.main_blocks(page)


def test_long_page():
    blocks = hx.main_blocks("<article>" + "".join(f"<p>{P1} {k}</p>" for k in range(3000)) + "</article>" + "<nav>" + "<li><a href=x>x</a>" * 3000)
    assert len(blocks) == 3000


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(labels):
            return sum(-min(w, 0) if keep else max(w, 0) for w, keep in zip(odds, labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])
        assert cost(hx.min_cut(odds, edges)) == pytest.approx(min(map(cost, itertools.product([True, False], repeat=n))))


def test_pages(spark, sf_small):
    from basketlens.llm.queries import op1_html_extraction
    rows = {r.page_id: r for r in op1_html_extraction(spark, sf_small).collect()}
    pages = spark.read.parquet(f"{sf_small}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        assert rows[p.page_id].url == p.url and rows[p.page_id].n_chars == len(rows[p.page_id].text)
        assert rows[p.page_id].text == "\n\n".join(hx.main_blocks(p.html))
        assert rows[p.page_id].text


def test_nulls_repeats_and_empty_table(spark):
    frame = spark.createDataFrame([(1, None, None, "t"), (None, "u", PAGE, "t"), (None, "u", PAGE, "t"), (2, "v", "", "t")], "page_id long, url string, html string, text string")
    got = hx.extract(frame).collect()
    assert len(got) == 4 and {r.text for r in got if r.page_id in (1, 2)} == {""} and all(r.n_chars == len(r.text) for r in got)
    assert hx.extract(frame.limit(0)).count() == 0
