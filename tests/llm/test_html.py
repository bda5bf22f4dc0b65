import re
from html import unescape

import pytest

from versoline.llm.html import extract, main_text, op3_html_extraction

CASES = [
    (None, ""), ("", ""), (" \n ", ""), ("plain &amp; text", "plain & text"),
    ("<p>One.<p>Two, three.", "One.\n\nTwo, three."),
    ("<p>a &lt;b&gt; &amp;amp; &eacute;&#x41;&#66;", "a <b> &amp; éAB"),
    ("<article><p>a\n  b\t<b>c</b><i>d</i><br>e</p></article>", "a b cd e"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
    ("<script>var t='</p>';</script><p>x<style>p{}</style> y<!-- <p>z</p> --></p>", "x y"),
    ("<p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<p>cut <b", "cut"),
    ('<p title="a>b">t', "t"),
]


@pytest.mark.parametrize(("html", "want"), CASES)
def test_cases(html, want):
    assert main_text(html) == want


LONG = "This is a sentence of the story, with commas, and of some length, as stories go. " * 2


@pytest.mark.parametrize(
    "around",
    [
        '<nav><ul><li><a href="/">{x}</a></ul></nav>', '<div class="sidebar"><p>{x}</p></div>', '<div id="comments"><article><p>{x}</p></article></div>', "<aside><p>{x}</p></aside>", "<footer><p>{x}</p></footer>", '<div class="cookie-notice"><p>{x}</p></div>',
        "<form><p>{x}</p></form>", '<div class="ad"><p>{x}</p></div>', '<div role="navigation">{x}</div>', '<div style="display: none"><p>{x}</p></div>', "<header><p>{x}</p></header>", '<section class="related-posts"><p>{x}</p></section>', '<div hidden="">{x}</div>',
    ],
)
@pytest.mark.parametrize("main", ["<article><h1>T</h1>{b}</article>", '<div class="page"><div id="content">{b}</div></div>', "<main>{b}</main>", "{b}"])
def test_what_surrounds_an_article_goes(around, main):
    other = around.format(x="Other words, that are long enough, to look like text of the page, but are not.")
    page = f"<html><body class='with-sidebar'>{other}{main.format(b=f'<p>{LONG}</p><p>Short.</p><p>{LONG}</p>')}{other}</body></html>"
    want = ["T"] * ("h1" in main) + [LONG.strip(), "Short.", LONG.strip()]
    assert main_text(page) == "\n\n".join(want)


LINKS = '<ul><li><a href="/a">One other page</a></li><li><a href="/b">Another</a></li></ul>'


@pytest.mark.parametrize("page", ["<main>{a}{b}</main>", "<body>{links}{a}{b}{links}</body>", "<div><div>{a}</div><div>{b}</div></div>", "<div><div><div>{a}</div></div>{links}<div><div>{b}</div></div></div>"])
@pytest.mark.parametrize("kind", ["section", "div"])
def test_sections_of_a_page_without_an_article_stay(page, kind):
    long = "".join(f"<p>{LONG}</p>" for _ in range(10))
    a = f"<{kind}>{long}</{kind}>"
    b = f"<h2>Then</h2>and bare <a href='/c'>text</a> too<ul><li>item</li></ul><table><tr><td>cell</table><{kind}><p>Short closing.</p></{kind}>"
    want = [LONG.strip()] * 10 + ["Then", "and bare text too", "item", "cell", "Short closing."]
    assert main_text(page.format(a=a, b=b, links=LINKS)) == "\n\n".join(want)


def test_deep_and_large():
    assert main_text("<div>" * 50_000 + "deep") == "deep"
    assert main_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert main_text("<" * 5000) == "<" * 5000


def test_columns(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "x"), (2, None, "y"), (2, None, "y")], "page_id int, html string, main_text string")
    assert sorted((r["page_id"], r["main_text"]) for r in extract(df).collect()) == [(1, "a"), (2, ""), (2, "")]
    assert extract(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op3_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == gold(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_words_with_other_senses_stay_in_an_article():
    inner = '<p class="legal">A ruling.</p><div class="share-price">Up by two.</div><section class="skip-list"><p>Level.</p></section><p>x <label>of it</label> y</p>'
    page = f'<article><p>{LONG}</p>{inner}<div class="share-buttons">Post</div><p class="notice">Cookies.</p><div class="ad">Buy.</div></article>'
    assert main_text(page) == "\n\n".join([LONG.strip(), "A ruling.", "Up by two.", "Level.", "x of it y"])


def test_time_is_linear_in_depth():
    import time

    def took(n):
        began = time.perf_counter()
        assert main_text("<p>a<button>" + "<div>" * n + "b") == "a"
        main_text("<ul><li>" + "<b>" * n + "<li>" * n)
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 20 * max(took(5000), 0.02)


def gold(html):
    """The blocks of a page of the test tables, by its own regular form: h1 and p of the article, but what stands in adverts."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    inner = re.sub(r'<div class="ad">.*?</div>', "", inner, flags=re.S)
    parts = re.findall(r"<(?:h1|p)>(.*?)(?=</(?:h1|p)>|<(?:h1|p)>|$)", inner, re.S)
    return "\n\n".join(filter(None, (" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts)))
