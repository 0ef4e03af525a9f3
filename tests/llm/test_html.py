import numpy as np
import pytest

from lattice.llm import html


@pytest.fixture(scope="module")
def model():
    return html.fitted()


def text(model, source):
    return html.extract([source], model)[0]


def test_generated_pages_held_out(model):
    rng = np.random.default_rng(99)
    pages = [html.sample_page(rng) for _ in range(150)]
    got = html.extract([p for p, _ in pages], model)
    assert np.mean([a == b for a, (_, b) in zip(got, pages, strict=True)]) > 0.85


def test_a_whole_page(model):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";track(0);</script><style>p{}</style></head><body>
    <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy now, it is cheap.</div>
    <article><h1>The  title</h1><p><b>First &amp; foremost,
    this is&nbsp;text &copy; with some length to it.<br><p>Second paragraph, which is also rather long and has words.</p><p>End.</p></article>
    <section class="comments"><h2>Comments</h2><p>I liked reading this very much, thank you for writing it.</p></section>
    <aside><h3>More</h3><ul><li><a href="/c">Other story</a></li></ul></aside><form><p>Subscribe to our letter</p><input></form>
    <footer>&copy; example.com &middot; all rights.</footer></body></html>"""
    assert text(model, page) == "The title\nFirst & foremost, this is text © with some length to it.\nSecond paragraph, which is also rather long and has words.\nEnd."


def test_odd_sources(model):
    for source in (None, "", "   ", "<", "<p", "<!--", "<script>never closed", "<div" * 300, "</div></p>", "&amp;&#65;", "<a href='x>y'>"):
        assert isinstance(text(model, source), str)
    assert text(model, "") == ""
    deep = "<div>" * 5000 + "<p>deep text</p>"
    assert isinstance(text(model, deep), str)


def test_decoding_is_hierarchical():
    page = html.Page("<div><nav><p>one</p></nav><p>two</p></div>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        odds = rng.normal(size=len(page.tag))
        keep = page.decode(odds)
        assert all(keep[page.parent[i]] for i in range(1, len(keep)) if keep[i])
        best = -np.inf
        n = len(keep)
        for mask in range(1 << (n - 1)):  # brute force over all consistent choices
            k = np.array([True, *(bool(mask >> i & 1) for i in range(n - 1))])
            if all(k[page.parent[i]] for i in range(1, n) if k[i]):
                best = max(best, odds[1:][k[1:]].sum())
        assert abs(odds[1:][keep[1:]].sum() - best) < 1e-9


def test_query_columns(spark):
    page = "<body><article><p>Some words of the article go here, enough of them.</p></article></body>"
    rows = [(1, "http://a/", page, 5), (1, "http://a/", page, 5), (None, None, None, 1), (2, "u", "", 0), (3, "u", "<p>" + "long words " * 100_000, 0)]
    out = html.main_texts(spark, spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 1] == ["Some words of the article go here, enough of them."] * 2
    assert html.main_texts(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
