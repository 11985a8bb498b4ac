"""Main text: markup that is broken, boilerplate of many kinds, accuracy on pages that were not learned from."""

import re
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from finsearch.llm import boosting, dom, extraction, queries


@pytest.fixture(scope="module")
def trees():
    return extraction.fitted()


def texts(html):
    return [t for t in dom.parse(html).texts if t]


@pytest.mark.parametrize(
    "html,expected",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<p><b>one<br><p>two", ["one", "two"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>x", ["1", "2", "3", "x"]),
        ("<p>a \n\t b&nbsp;c<!-- <p>no --> d</p>", ["a b c d"]),
        ('<script>var t="</p><p>x";</script><p>y</p><style>p{}</style>', ["y"]),
        ("<textarea>no</textarea><SCRIPT>no</SCRIPT >yes<script>never closed", ["yes"]),
        ("1 < 2 and <p class='a>b'>c</p>", ["1 < 2 and", "c"]),
        ('<p title="never closed>a</p><p>b</p>', ["a", "b"]),
        ("<div>a<span>b</span>c</div></div></p>d", ["abc", "d"]),
        ("&lt;p&gt; &eacute;&#233;&#x1F600; &#9999999;", ["<p> éé😀 �"]),
        ("<![CDATA[x]]><?php x ?>a</>b<", ["ab<"]),
    ],
)
def test_blocks(html, expected):
    assert texts(html) == expected


def test_long_and_hostile_pages_end():
    for html in ("<div>" * 20_000 + "x", "<" * 200_000, '<a "' * 5000, "</p>" * 50_000, "<p>" * 30_000, "&" * 100_000, "<!--" + "x" * 100_000):
        tree = dom.parse(html)
        assert len(dom.features(tree)) == len(tree.tags)


def test_choice_takes_whole_subtrees():
    tree = dom.parse("<div><p>a</p><p>b</p></div><nav><p>c</p></nav>")
    odds = {"#root": 5, "div": 1, "nav": -3, "p": 2}
    kept = dom.decoded(tree, np.array([odds.get(t, 2) for t in tree.tags], dtype=float))
    assert [t for t, k in zip(tree.texts, kept) if k and t] == ["a", "b", "c"]  # the likely children outweigh it
    odds = {"#root": 5, "div": 1, "nav": -9, "p": 2}
    kept = dom.decoded(tree, np.array([odds.get(t, 2) for t in tree.tags], dtype=float))
    assert [t for t, k in zip(tree.texts, kept) if k and t] == ["a", "b"]
    for i, keep in enumerate(kept):
        assert not keep or i == 0 or kept[tree.parents[i]]


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    rows = rng.random((4000, 5)).astype(np.float32)
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 3] > 0.3)).astype(float)
    model = boosting.fit(rows[:3000], labels[:3000])
    assert ((model.score(rows[3000:]) > 0) == labels[3000:]).mean() > 0.97


def test_pages_not_learned_from(trees):
    composer = extraction.Composer(2026)
    right = blocks = missed = extra = 0
    for _ in range(300):
        html = composer.page()
        tree, own = extraction.labelled(html)
        expected = [t for t, o in zip(tree.texts, own) if o and t]
        got = [t for t in extraction.main_texts([html.replace(extraction.OWN, "")], trees)[0].split("\n\n") if t]
        right += got == expected
        blocks += len(expected)
        missed += sum((Counter(expected) - Counter(got)).values())
        extra += sum((Counter(got) - Counter(expected)).values())
    assert right > 0.8 * 300 and missed < 0.03 * blocks and extra < 0.05 * blocks


PAGE = """<html><head><title>T</title></head><body><header class="site-header"><a href="/">Site</a><p>Our motto.</p></header>
<nav><ul><li><a href="/a">Home.</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies to make this site better for you, please agree.</p><button>OK</button></div>
<main><article><h1>Title &amp; more</h1><p>First   paragraph of the story, which is long enough to look like text.</p><div class="advert"><p>Buy now, it is cheap.</p></div>
<p>Short.</p><blockquote>A quotation of somebody, in the middle.</blockquote><p>Last paragraph of the story, it ends here.</p></article></main>
<aside class="sidebar"><h3>Related</h3><p>Another story that you could read too.</p></aside><section class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I do not agree with this story at all, it is wrong in many ways.</p></div></section>
<form action="/s"><label>Your mail</label><input name="m"><button>Subscribe</button></form><footer><p>&copy; Site, all rights reserved.</p></footer></body></html>"""
MAIN = ["Title & more", "First paragraph of the story, which is long enough to look like text.", "Short.", "A quotation of somebody, in the middle.", "Last paragraph of the story, it ends here."]


def test_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", PAGE), (4, "x", PAGE), (4, "x", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit(-1)).withColumn("tags", F.lit("kept"))
    got = extraction.extracted(pages.repartition(3)).collect()
    main = "\n\n".join(MAIN)
    assert sorted((r["page_id"] or 0, r["url"] or "", r["tags"], r["text"], r["n_chars"]) for r in got) == sorted(
        (i or 0, u or "", "kept", main if h else "", len(main) if h else 0) for i, u, h in rows
    )
    assert extraction.extracted(pages.limit(0)).count() == 0


def test_query_on_given_pages(spark):
    folder = "/root/testdata/sf0.01"
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.QUERIES["op5_html_extraction"](spark, folder).collect()
    assert len(rows) == len(html)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_text_of_formulas_and_fallbacks_stays():
    para = "<p>" + "A sentence of the article that says a thing or two, and then one more of them. " * 4 + "</p>"
    inner = "<p>The value <math><mi>alpha</mi><mo>=</mo><mn>42</mn></math> is known, <object>fallback words</object> and <noscript>plain words</noscript> stay in the text of it.</p>"
    html = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A title</h1>{para}{inner}<xmp>typed words as they are</xmp>{para}</article></body></html>"
    text = extraction.main_texts([html], extraction.fitted())[0]
    for words in ("alpha=42", "fallback words", "plain words", "typed words as they are"):
        assert words in text, text
    assert "Home" not in text
