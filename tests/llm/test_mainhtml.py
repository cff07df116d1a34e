import html
import re
import time

import pytest

from commitloom.llm import mainhtml, queries

TEXT = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod. "

CASES = {
    "article": (
        '<html><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies, yes, and, more, of, them.</div>'
        '<div class="content-wrapper"><main><article class="post"><header><h1>Title</h1><p class="byline">By A</p></header><div class="entry-content"><p>One&nbsp;two &amp; three, &#233;.</p>'
        "<ul><li>a<li>b</ul><table><tr><td>x<td>y</table><pre>a  b\n c</pre><aside>no</aside><form><p>no</p></form><div class=\"share-buttons\">no</div><p>End <a href='#'>link</a>.</p></div>"
        f'<footer>no</footer></article></main><div class="sidebar"><p>{TEXT * 9}</p></div></div><section id="comments"><article class="comment"><p>{TEXT * 8}</p></article></section><footer>no</footer></body></html>',
        "Title By A One two & three, é. a b x y a b c End link.",
    ),
    "no kinds": (
        f'<div class=wrap><div class=menu><a href=1>a</a> <a href=2>b</a></div><div id=x1><h2>Head</h2><div><p>{TEXT}</p></div><div><p>{TEXT}</p></div></div><div class=comments><p>{TEXT * 9}</p></div></div>',
        f"Head {TEXT * 2}",
    ),
    "unnamed menus": (f"<div><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><div><p>{TEXT}<p>{TEXT}</div></div>", TEXT * 2),
    "text alone": ("plain text only", "plain text only"),
    "unclosed": ("<p>a<p>b<b>c</b>d<br>e", "a bcd e"),
    "script": ('<script>if (a<b) "</p>"</script><p>x</p><style>p{}', "x"),
    "comments": ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no", "yes"),
    "no tags": ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"),
    "free of adverts": (f'<div class="ad-free content"><p>{TEXT}</p></div>', TEXT),
    "short article": (f"<article><p>short.</p></article><div><p>{TEXT * 9}</p></div>", "short."),
    "wrapper with a telling name": ('<body><div class="sidebar-menu" id="wrap"><article><p>Hi, there.</p></article></div></body>', "Hi, there."),
    "roles": (f'<div role=main><h1>T</h1><div><p>{TEXT}</p></div><div class="related"><p>no</p></div></div><div role=banner>{TEXT * 9}</div>', f"T {TEXT}"),
    "tables as layout": (f"<table><tr><td class=nav>no</td><td>{TEXT}<br>{TEXT}</td></tr></table>", TEXT * 2),
    "hidden": (f'<article><p hidden>no</p><p style="display: none">no</p><p>{TEXT}</p></article>', TEXT),
    "cut tag": ("<p>a</p", "a"),
    "quotes": ('<p title="a > b">t</p>', "t"),
    "nothing": ("<nav>x</nav>", ""),
    "white space": (" \n\t <p> </p>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_pages_of_many_shapes(name):
    page, want = CASES[name]
    assert mainhtml.main_text(page) == " ".join(want.split())


@pytest.mark.parametrize(
    "page",
    ["<div>" * 20_000 + "x", "<b><div>" * 20_000 + "x" + "</i>" * 20_000, "<p>a</p>" * 50_000, '<a href="' * 20_000, "<div class=ad>" * 20_000 + "<article>x", "<!--" * 50_000, "<ul><li>" * 20_000, "<" * 100_000, "</div>" * 50_000, "<td><b>" * 10_000 + "</td>" * 10_000, "<p>" + "word, " * 200_000],
)
def test_cost_grows_with_the_page(page):
    began = time.process_time()
    mainhtml.main_text(page)
    assert time.process_time() - began < 10


def test_points_go_to_ancestors_and_links_take_from_them():
    root = mainhtml.tree(f"<div id=a><div id=b><p>{TEXT}</p><p>{TEXT}</p></div><div id=c><p><a>{TEXT}</a></p></div></div>")
    elements = mainhtml.inside(root)
    mainhtml.score(elements)
    a, b, c = (next(x for x in elements if x.name.get("id") == k) for k in "abc")
    one = mainhtml.passed(TEXT.strip())
    assert one == len(TEXT.strip()) / 100 + 2 + 1
    assert (b.points, c.points, a.points) == (2 * one, one, 2 * one / 2 + one / 2)
    assert mainhtml.density(c) == 1 and mainhtml.value(c) == 0 and mainhtml.value(b) == 2 * one


def test_rows(spark):
    rows = [(1, "u", "<article><p>é 😀</p></article>", "t"), (1, "u", "<article><p>é 😀</p></article>", "t"), (None, None, None, "t"), (3, "v", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, mainhtml.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "é 😀", 3), (1, "u", "é 😀", 3), (None, None, "", 0), (3, "v", "", 0)], key=str)
    assert mainhtml.extract(pages.limit(0)).collect() == []


def article_of(page):
    """The delivered pages have one article each, and in it only blocks, bold text and line breaks."""
    inner = page[page.index("<article>") + 9 :]
    end = inner.find("</article>")
    inner = inner[:end] if end >= 0 else inner.split("<footer")[0]
    return " ".join("".join(("" if p in ("<b>", "</b>") else " ") if p.startswith("<") else html.unescape(p) for p in re.split(r"(<[^>]*>)", inner)).split())


def test_query_finds_the_delivered_articles(spark):
    data = "/root/testdata/sf0.01"
    rows = queries.op11_html_extraction(spark, data).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        want = article_of(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))
