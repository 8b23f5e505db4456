from __future__ import annotations

import html
import re

import pandas as pd
import pytest

from chatweave.llm import html_templates as H
from chatweave.llm.queries import op1_html_templates
from tests.conftest import SF_CHECK


def text_of(page):
    return H.main_text(H.parse(page), lambda h: False)[0]


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"),
    ("<article><h1>T</h1><p><b>One.<br><p>Two &amp; t&eacute;</p></article>", "T\nOne.\nTwo & té"),
    ("<nav>menu</nav><div id=main-text><p>a</p>b<p>c</div><footer>f</footer>", "a\nb\nc"),
    ("<script>var t='</p>';</script><style>p{}</style><!-- x --><p>y</p>", "y"),
    ("<main><header><h1>Title</h1></header><p>x</p><aside>side</aside></main><p>out</p>", "Title\nx"),
    ("<article><p>a</p><div class='comments'><p>first!</p></div><form><p>mail</p></form></article>", "a"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></article>", "one\ntwo\n1\n2"),
    ("<p class='ad'>buy</p><p class='note'>kept</p><div class='sidebar'>s</div>", "kept"),
    ("<p title=it's>First.</p><p>Second, don't drop.</p><p>Third.</p>", "First.\nSecond, don't drop.\nThird."),
    ("<p title=\"a\"b\">x</p><p a='1>2' b=\"<i>\" c=d'e>y</p>", "x\ny"),
    ("<p x = 'a>b'>in</p><p y='open>next</p><p>on</p>", "in\nnext\non"),
    ("a < b <a b <c " * 3, "a < b <a b <c a < b <a b <c a < b <a b <c"),
    ("<!-- <p>no</p>", ""),
    ("<p>cut <a href='x'>off", "cut off"), ("<p>1 < 2 and &#65; &unknown; &amp", "1 < 2 and A &unknown; &"),
    ("<div hidden>no</div><div style='display: none'>no</div>yes", "yes"),
    ("<p>" + "long " * 50_000 + "</p>", ("long " * 50_000).strip()),
])
def test_main_text(page, want):
    assert text_of(page) == want


SITE = "<body><div><b>Site {s}</b> slogan</div><section><p>{text}</p></section><div>Read on {s}</div></body>"


def site_pages():
    rows = [(i, f"http://a.org/{i}", SITE.format(s="A", text=f"text number {i}")) for i in range(8)]
    rows += [(20 + i, "http://a.org/copy", SITE.format(s="A", text="copied page")) for i in range(8)]
    rows += [(40, "https://b.org/", SITE.format(s="A", text="other host")), (41, None, None), (41, None, None), (None, "no host", "<p>x</p>")]
    return rows


@pytest.mark.parametrize("most_keys", [H.MOST_KEYS, 0])
def test_templates_are_deleted_per_host(spark, most_keys):
    pages = spark.createDataFrame(site_pages(), "page_id long, url string, html string").selectExpr("*", "'z' AS text", "1 AS host", "2 AS key")
    got = H.extract(pages, ["page_id", "url"], most_keys=most_keys).toPandas()
    want = {i: f"text number {i}" for i in range(8)} | {20 + i: "copied page" for i in range(8)}
    want |= {40: "Site A slogan\nother host\nRead on A", 41: "", -1: "x"}
    assert len(got) == len(site_pages())
    for i, text, n in zip(got.page_id.fillna(-1), got.text, got.n_chars):
        assert (text, n) == (want[int(i)], len(want[int(i)]))
    assert set(got[got.page_id < 30].n_template_blocks) == {2}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract(pages, ["page_id"]).collect() == []


def test_query_against_plain_reading(spark):
    pages = pd.read_parquet(f"{SF_CHECK}/pages.parquet")
    got = op1_html_templates(spark, SF_CHECK).toPandas().set_index("page_id")
    for i, page in zip(pages.page_id, pages.html):
        article = re.search("<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", article)]
        assert got.text[i] == "\n".join(x for x in blocks if x)


LONG = "the article has more text than what surrounds it"


@pytest.mark.parametrize("page, want", [
    (f"<div class='content with-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div id='page' class='has-sidebar'><nav>menu</nav><article><p>{LONG}</p></article></div>", LONG),
    (f"<body><form id='aspnet'><nav>menu</nav><article><p>{LONG}</p></article><div class='ad'>buy</div></form></body>", LONG),
    (f"<form><article><p>x</p></article></form><p>{LONG}</p>", "x"),
    ("<form><main><p>a</p></main><div class='comments'><article>a first comment, longer</article></div></form>", "a"),
    (f"<div class='banner'><article><p>{LONG}</p></article></div><p>stray</p>", LONG),
    (f"<div class='modal'><div class='widget'><main><p>{LONG}</p><div class='share'>s</div></main></div></div>", LONG),
    ("<article><div class='article-header'><h1>Title</h1></div><div class='notice-text'>n</div><div class='social-policy'><p>s</p></div></article>", "Title\nn\ns"),
    ("<article><div class='header'><h1>Title</h1></div><p>x</p></article>", "Title\nx"),
    # articles that are not the main one stay where they are
    ("<article><p>a</p></article><div class='comments'><article>a longer comment</article></div>", "a"),
    (f"<div class='sidebar'><article>teaser</article></div><div><p>{LONG}</p></div>", LONG),
    (f"<main><p>{LONG}</p><div class='comments'><article>first!</article></div></main>", LONG),
    (f"<p>{LONG}</p><form><input><p>mail</p></form>", LONG),
])
def test_roles_of_elements_that_hold_the_article_do_not_count(page, want):
    assert text_of(page) == want


def test_section_template_of_a_large_host(spark):
    page = "<body><div>{block}</div><section><p>text number {i}</p></section></body>"
    block = lambda i: "Section news, weekly" if i < 60 else f"seldom {i // 10}" if i < 100 else f"own {i}"
    rows = [(i, f"https://large.org/{i}", page.format(block=block(i), i=i)) for i in range(6500)]  # 60 pages are below 1 %
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).toPandas().set_index("page_id")
    assert all(got.text[i] == f"text number {i}" for i in range(60))
    assert all(got.text[i] == f"{block(i)}\ntext number {i}" for i in range(60, 6500))


@pytest.mark.parametrize("page, want", [
    # reader comments and teasers are articles of their own
    (f"<article><p>{LONG}</p><article class='comment'><p>first!</p></article></article>", LONG),
    (f"<article><p>{LONG}</p></article><article class='comment'><p>a longer comment than the article itself, by far, by far</p></article>", LONG),
    (f"<main><p>{LONG}</p><p>{LONG}</p><article><p>teaser</p></article></main>", f"{LONG}\n{LONG}"),
    (f"<main><h1>Headline</h1><article><p>{LONG}</p></article><p>after</p></main>", f"Headline\n{LONG}"),
    (f"<main><h1>Section</h1><article><h1>Own</h1><p>{LONG}</p></article></main>", f"Own\n{LONG}"),
    (f"<article class='comment'><p>{LONG}</p></article>", LONG),  # the page's only article is a column
    # adverts and notices of any element
    (f"<article><p>{LONG}</p><p class='ad'>buy</p><p class='notice'>n</p><p>a <span class='advert'>b</span> c</p></article>", f"{LONG}\na b c"),
    *[(f"<article><p>{LONG}</p><div class='{c}'><p>gone</p></div></article>", LONG) for c in (
        "comment-list", "comment-body", "ad-slot", "cookie-banner", "related-posts", "top-ad", "user-comments", "newsletter-signup", "page_sidebar_nav x-menu")],
    *[(f"<article><p>{LONG}</p><div class='{c}'><p>kept</p></div></article>", f"{LONG}\nkept") for c in (
        "article-header", "notice-text", "social-policy", "entry-content", "post-body", "with-sidebar", "has-ads", "lead-in", "commentary", "adverse-events", "navigate")],
])
def test_comments_teasers_and_adverts(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("make", [
    lambda n: "<div>" * n + "deep", lambda n: "<div><p>x" * n, lambda n: "<ul><li>" * n + "y", lambda n: "<a <b " * n, lambda n: "<p x='" * n + ">", lambda n: "<i>" * n + "</b>" * n,
    lambda n: "<div class='ad'><article>" * n + "z", lambda n: "<table><tr><td>" * n, lambda n: "<!-- " * n,
])
def test_time_grows_with_the_page_not_its_square(make):
    import time

    def seconds(n):
        t = time.process_time()
        text_of(make(n))
        return time.process_time() - t

    seconds(100)
    assert seconds(40_000) < 16 * seconds(5_000) + 0.5
