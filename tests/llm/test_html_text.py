"""Main text of pages: markup of many kinds, and the method's steps by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.llm import html_text as ht

LONG = "A sentence of some length that says what happened on the day in question. " * 4


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("   \n ", ""),
    ("plain text\n  without tags", "plain text without tags"),
    ("<p>a &amp; b&nbsp;&copy; &#233;</p>", "a & b © é"),
    ("<article><h1>T</h1><p>x<b>y</b>z<br>w</p><p>Os.</p></article>", "T xyz w Os."),
    ("<body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><article><p>Short.</p></article><footer>" + LONG + "</footer>", "Short."),
    ("<article><p>Text.</p><script>var a='</p><p>no</p>';</script><style>p{}</style><!-- no --><p>More.</p></article>", "Text. More."),
    ("<article><p>Text.</p><div class='comments'><p>" + LONG + "</p></div><aside>side</aside><form>name <input></form></article>", "Text."),
    ("<main><div id='cookie-notice'>We use cookies</div><p>One</p><div class=\"ad\">buy</div><p>Two</p></main>", "One Two"),
    ("<article><p><b>Open bold.<br></article><footer>foot</footer>", "Open bold."),
    ("<article><p>One<p>Two<li>three</article>", "One Two three"),
    ("<article><div style='display:none'>no</div><p hidden>no</p><p>yes</p></article>", "yes"),
    ("<article><header><h1>Title</h1></header><p>Body.</p></article>", "Title Body."),
    ("<div class='advert'>only this</div>", "only this"),
    ("<a href=/x>nothing but a link</a>", ""),
    ("<p>a < b and c > d</p>", "a < b and c > d"),
])
def test_pages(html, want):
    assert ht.main_text(html) == want


def test_without_an_article_element():
    menu = "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(12))
    paragraphs = [f"{k}. {LONG.strip()}" for k in range(5)]
    html = (f"<html><body><div><ul>{menu}</ul></div><div id='c'><h2>Headline</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs[:3])
            + "<p>Brief.</p>" + "".join(f"<p>{p}</p>" for p in paragraphs[3:]) + f"</div><div><ul>{menu}</ul></div></body></html>")
    got = ht.main_text(html)
    assert got.endswith(" ".join([*paragraphs[:3], "Brief.", *paragraphs[3:]]))
    assert "Entry" not in got


def test_smoothing_is_a_gaussian_convolution():
    x = np.random.default_rng(0).random(17) * 50
    w = {d: math.exp(-0.5 * (d / ht.SIGMA) ** 2) for d in range(-ht.REACH, ht.REACH + 1)}
    total = sum(w.values())
    want = [sum(w[d] * x[i + d] for d in w if 0 <= i + d < len(x)) / total for i in range(len(x))]
    assert np.allclose(ht.smoothed(x), want)
    assert len(ht.smoothed(x[:1])) == 1


def test_ratio_and_threshold_by_hand():
    parser = ht.lines_of("<div><p>" + "x" * 100 + "</p><p><a>link link</a> y</p><p>" + "z" * 80 + "</p></div>")
    assert [(x.tags, x.link, len(x.text)) for x in parser.lines] == [(2, 0, 100), (4, 9, 11), (2, 0, 80)]
    ratios = np.array([100 / 2, 2 / 4, 80 / 2])
    level = ht.smoothed(ratios)
    assert list(ht.content_lines(parser.lines, np.zeros(3, bool))) == list(level >= level.std())


def test_long_page_and_deep_nesting():
    text = "word " * 200_000
    assert ht.main_text(f"<article><p>{text}</p></article>") == text.strip()
    assert ht.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_query_columns_and_clashing_names(spark):
    rows = [(1, "u", "<article><p>A</p></article>"), (1, "u", "<article><p>A</p></article>"), (2, None, None), (None, "v", "<p>é</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("__html", F.lit("clash"))
    got = ht.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "A"), (1, "u", "A"), (2, None, ""), (None, "v", "é")], key=str)
    assert ht.extract(df.limit(0)).count() == 0
