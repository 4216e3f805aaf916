"""Page text: held-out labelled pages, all given pages by their article element, odd markup."""

import html
import re

import numpy as np
import pytest

from dataprobe.llm import crf, htmltext


@pytest.fixture(scope="module")
def chain():
    return htmltext.fit()


def test_held_out_pages(chain):
    xs, ys = htmltext.training_set(200, 99)
    right = [np.array(crf.viterbi(chain, chain.emissions(x))) == y for x, y in zip(xs, ys)]
    assert 0.2 < np.concatenate(ys).mean() < 0.8
    assert np.concatenate(right).mean() > 0.98


def test_given_pages(spark, chain):
    """All text inside the article element, nothing outside."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in htmltext.extract(pages, chain=chain).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(p|br|/p|/h1)>", " ", inside))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_blocks():
    got = htmltext.blocks('<p>a<b>b</b>c <i> d</i><br>e<p>f &amp; g&nbsp;h<div>i<!-- no > --></div>j<script>"</p>k"</script><ul><li>l<li>m <a href="x>y">n</a></ul><td>o < p &am')
    assert [(t, x) for t, _, x, _ in got] == [("p", "abc d e"), ("p", "f & g h"), ("div", "i"), ("body", "j"), ("li", "l"), ("li", "m n"), ("td", "o < p &am")]
    assert got[5][3] == 1
    assert htmltext.blocks("a<p class='x") == [("body", 0, "a", 0)] and htmltext.blocks("a<!-- b") == [("body", 0, "a", 0)]
    assert htmltext.blocks("<title>x</title><style>p{}</style><script>y") == []


def test_parts_that_are_not_the_article(chain):
    text = "The quick brown fox jumps over the lazy dog, and then it sleeps for a long while in the warm sun. "
    page = f"""<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-banner">We use cookies. <button>OK</button></div><main><h1>Head line of it</h1><p>{text * 3}<p>{text}
    <div class="ad">Buy now, it is cheap.</div><blockquote>{text}</blockquote><form><label>Mail</label><input></form></main>
    <aside><h3>Related</h3><ul><li><a href=1>Another story of today</a></ul></aside><section id="comments"><h3>Comments</h3><p>I like that very much.</p></section>
    <footer>&copy; 2020 Site. All rights reserved.</footer></body></html>"""
    t = text.strip()
    assert htmltext.main_text(page, chain) == f"Head line of it {t} {t} {t} {t} {t}"


def test_odd_rows(spark, chain):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<"), (3, "u", "<p>" * 20000), (3, "u", "<p>" * 20000), (4, "u", "<div>" * 500 + "x"), (5, "u", "</p></div>&#0;&#xD800;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = htmltext.extract(df, chain=chain).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract(df.limit(0), chain=chain).collect() == []
