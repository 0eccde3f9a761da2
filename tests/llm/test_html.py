import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meetspark.llm import html

LONG = "This is a sentence of some length about nothing at all, and it goes on. " * 3
T = " ".join(LONG.split())

CASES = {
    "": "",
    "<p>a": "a",
    f"<nav>Menu</nav><article><h1>Title</h1><p>One &amp; two<br>three</p><p>{LONG}<b>bold</b>x</p></article><footer>f</footer>": f"Title\n\nOne & two three\n\n{T} boldx",
    f'<div class="content"><p>{LONG}</p><div class="ad">Buy</div><p>{LONG}</p></div><div id="comments"><p>{LONG}</p></div>': f"{T}\n\n{T}",
    f"<body class='has-sidebar'><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul><div><p>{LONG}</p><p>Short.</p></div></body>": f"{T}\n\nShort.",
    f'<script>var t="</p><article>";</script><style>p{{}}</style><main><p>{LONG}<p>next</main>': f"{T}\n\nnext",
    f"<nav><ul><li>never closed<article><p>{LONG}</p></article>": T,
    "<article><p>cut &am": "cut &am",
    "<article><p>cut <a href=": "cut",
    "<article><p>a < b and 1<2</p></article>": "a < b and 1<2",
    "<article><p>x</p><form><input><p>name</p></form><aside>side</aside><p>y&nbsp;z</p></article>": "x\n\ny z",
    "<article><header><h1>Head</h1></header><p>x</p><div class='reader-comments'><article>No</article></div></article>": "Head\n\nx",
    "<!-- <article>no</article> --><article><p hidden>h</p><p title='a>b'>yes</p></article>": "yes",
    "<table><tr><td>a</td><td>b</td></tr></table>": "a b",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert html.main_text(page) == CASES[page]


BODY, END = " ".join([T] * 10), T[:150]
AD, SHARE = "<div class='ad'>Buy this</div>", "<div class='share'>Share this</div>"
UNMARKED = {
    f"<div><h1>Title</h1>{SHARE}<p>{BODY}</p>{AD}<p>{END}</p>{AD}<p>The end.</p></div>": f"Title\n\n{BODY}\n\n{END}\n\nThe end.",
    f"<body><h1>Title</h1>{SHARE}<div><p>{BODY}</p></div>{AD}<p>The end.</p></body>": f"Title\n\n{BODY}\n\nThe end.",
    f"<body><div>Our slogan</div>{AD}<div><h2>Title</h2>{SHARE}<div><p>{BODY}</p></div>{AD}<p>The end.</p><p><a href=x>Next</a></p></div>{AD}<div>Made in 2020</div></body>": f"Title\n\n{BODY}\n\nThe end.",
    f"<div>{BODY}</div>{AD}<div>Short.</div>{AD}<div>{END}</div>": f"{BODY}\n\nShort.\n\n{END}",
}


@pytest.mark.parametrize("page", UNMARKED)
def test_no_text_of_an_unmarked_article_is_dropped(page):
    assert html.main_text(page) == UNMARKED[page]


NAMED = {
    f"<div class='container has-sidebar'><h1>Title</h1><p>{T}</p><div class='sidebar'>Side</div></div>": f"Title\n\n{T}",
    f"<article class='post comments-open'><p>{T}</p></article>": T,
    f"<article class='post category-social'><p>{T}</p><div class='social'>Like</div></article><div id='comments'><p>{BODY}</p></div>": T,
    f"<div id='page' class='left-sidebar'><div class='comments'>{BODY}</div><article><p>{T}</p></article></div>": T,
    f"<div class='right-rail'><p>{T}": T,
    f"<div class='banner'><main><p>{T}</p></main></div>": T,
    f"<div class='right-rail'><p>{T}</p></div><div>Made in 2020</div>": f"{T}\n\nMade in 2020",
    f"<div class='left-sidebar'><h1>Title</h1><p>{T}</p><div id='comments'><article>{BODY}</article></div></div>": f"Title\n\n{T}",
    f"<article><header class='entry-header'><h1>Title</h1></header><div class='post-header'>By me</div><p>{T}</p></article>": f"Title\n\nBy me\n\n{T}",
    f"<div><div class='entry-header'><h1>Title</h1></div><p>{T}</p></div><div class='page-header'>No</div>": f"Title\n\n{T}",
    f"<article><svg class='i'/><p>{T}</p><svg/><p>b</p><button disabled/><p>c</p><iframe src=/x/>no</iframe><svg a='>'>no</svg><p>d</p></article>": f"{T}\n\nb\n\nc\n\nd",
    f"<article><button-group><p>{T}</p></button-group><map-view>x</map-view></article>": f"{T}\n\nx",
    f"<div><p>{T}</p></div><div class='comment'><h1>Hi</h1><p>{END}</p></div><div hidden><main>{BODY}</main></div>": T,
}


@pytest.mark.parametrize("page", NAMED)
def test_names_and_classes_drop_what_they_mark_only(page):
    assert html.main_text(page) == NAMED[page]


OWN = {
    f"<article><p>{T}</p><blockquote class='notice-text'>Quote</blockquote><div class='legal-history'>Law</div><ul class='share-prices'><li>Up</li></ul></article>": f"{T}\n\nQuote\n\nLaw\n\nUp",
    f"<div class='comments-free content'><p>{T}</p></div><div class='cookie-notice'>Ok</div><div class='post-comments'>Hm</div><div id='adBox'>Buy</div>": T,
    f"<article class='teaser-text'>Short.</article><div><h1>Big</h1><p>{T}</p></div>": f"Short.\n\nBig\n\n{T}",
    f"<article><p>Short.</p></article><section><h1>Big</h1><p>{T}</p></section>": f"Short.\n\nBig\n\n{T}",
    f"<main><h1>Big</h1><p>{T}</p></main><article><p><a href=x>Read this too</a></p></article>": f"Big\n\n{T}",
    f"<article><p>{T}</p><!-- a > b": T,
    f"<article><p>{T}</p><script>if (a > b) {{": T,
    "<article><p>a<p>b <i": "a\n\nb",
}


@pytest.mark.parametrize("page", OWN)
def test_marks_in_names_and_regions_of_short_articles(page):
    assert html.main_text(page) == OWN[page]


LEAVES = st.tuples(st.sampled_from(["p", "p", "p", "h2", "link", "ad", "nav"]), st.integers(1, 130).map(lambda n: ("word " * 30)[: n - 1] + "w"))
TREES = st.recursive(LEAVES, lambda x: st.tuples(st.sampled_from(["div", "div", "article"]), st.lists(x, max_size=4)), max_leaves=14)


def _page(node):
    kind, inside = node
    if isinstance(inside, list):
        return f"<{kind}>{''.join(map(_page, inside))}</{kind}>"
    return {"link": f"<p><a href=x>{inside}</a></p>", "ad": f"<aside>{inside}</aside>", "nav": f"<nav><p>{inside}</p></nav>"}.get(kind, f"<{kind}>{inside}</{kind}>")


def _brute(body):
    """The method by its definition, from the tree itself: lines, sums over all windows, surge and dive points, and the block that holds the regions."""
    lines, stories = [], [0]

    def go(node, story, child):
        kind, inside = node
        if isinstance(inside, list):
            if kind == "article" and not story:
                stories[0] += 1
                story = stories[0]
            for x in inside:
                go(x, story, child)
        elif kind in ("ad", "nav"):
            lines.extend([None] * 6)
        else:
            lines.append((" ".join(inside.split()), kind == "link", story, child, kind == "h2"))

    for i, node in enumerate(body):
        go(node, 0, (i + 1) if isinstance(node[1], list) or node[0] == "h2" else 0)

    def region_lines(lengths):
        found, begun = set(), False
        for i in range(len(lengths)):
            window = sum(lengths[i : i + 3])
            if not begun and lengths[i] and window >= 80:
                begun = True
            if begun and lengths[i]:
                found.add(i)
            if sum(lengths[i + 1 : i + 4]) == 0:
                begun = False
        return found

    lengths = [0 if x is None or x[1] else len(x[0]) for x in lines]
    found = region_lines(lengths)
    some = [i for i, x in enumerate(lines) if x and x[2]]
    if some and (not found or region_lines([n if x and x[2] else 0 for x, n in zip(lines, lengths)])):
        live = {lines[i][2] for i in some if lengths[i]} or {lines[i][2] for i in some}
        return "\n\n".join(lines[i][0] for i in some if lines[i][2] in live)
    holders = {lines[i][3] for i in found}
    if len(holders) == 1 and (only := holders.pop()) and any(x and n and x[3] == only and x[4] for x, n in zip(lines, lengths)):
        return "\n\n".join(x[0] for x, n in zip(lines, lengths) if n and x[3] == only)
    return "\n\n".join(x[0] for x, n in zip(lines, lengths) if n)


@given(st.lists(TREES, max_size=6))
@settings(max_examples=300, deadline=None)
def test_against_brute_force_over_the_tree(body):
    assert html.main_text(f"<body>{''.join(map(_page, body))}</body>") == _brute(body)


HOSTILE = ["<div>" * 50000 + "</p>" * 50000, "<a" * 50000, "<a " * 50000 + ">", "<div>" * 30000 + "</section>" * 30000, "<nav>" * 20000 + "<article>" * 20000, "<a '> x " * 20000 + "<p \"> " * 20000, "<script>x</scrip" * 20000, "<!-- x " * 50000 + ">"]


@pytest.mark.parametrize("page", HOSTILE, ids=range(len(HOSTILE)))
def test_time_grows_with_the_page_only(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 5  # those in proportion to the square took a minute or more


@given(st.text(alphabet="<>/!-\"'=apdivnrtcle &;#x", max_size=200))
@settings(max_examples=300, deadline=None)
def test_never_fails(page):
    html.main_text(page)


def test_table(spark):
    rows = [(1, "u", None), (None, None, "<p>x"), (2, "u", "<article>" + "<p>é word</p>" * 30000), (2, "u", ""), (2, "u", "")]
    out = html.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect()
    assert sorted((r.n_chars, len(r.text)) for r in out) == [(0, 0)] * 3 + [(1, 1), (30000 * 6 + 2 * 29999, 30000 * 6 + 2 * 29999)]
    assert html.extract_articles(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
