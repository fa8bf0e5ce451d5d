import html
import re

import pytest

from scriptorium.llm import html_wrappers as hw, queries

from llm_tables import SF01

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body>
<header class="site"><h1>Site</h1>slogan</header><nav><ul><li>menu<li>more</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar">side</div>
<article><header><h1>The  &eacute;v&#233;nement</h1><p>by someone</p></header>
<p>First &lt;b&gt; <b>bold</b>text<br>next&nbsp;line
<p>Second <script>var x="</p>";</script>part <!-- no --><span class="ad">buy</span>end
<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>
<form><input value="x"><button>Send</button>form</form><aside>note</aside>
<h2>Sub</h2>loose text<p></p><pre> x
  y</pre><section id="comments"><article class="comment"><p>nice!</p></article></section></article>
<div class="related"><p>read this</p></div><footer>&copy; all</footer></body></html>"""
TEXT = "The événement\nFirst <b> boldtext next line\nSecond part end\none\ntwo\na\nb\nc\nSub\nloose text\nx y"


def test_one_page():
    assert hw.main_text(PAGE, hw.page_wrapper(PAGE)) == TEXT == hw.main_text(PAGE)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<", "<"), ("plain &amp; &unknown; a<b", "plain & &unknown; a<b"), ("<p>a<p", "a<p"),
    ("<article><p>x</article><footer>f", "x"), ("<main>m</main><p>o</p>", "m"), ("<div class=content><p>c</div><p>o", "c"),
    ("<article><p>a</article><p>o<article>b", "a\nb"), ("<!-- open <p>x", ""), ("<script>x", ""),
    ("<p title='a>b'>q</p>", "q"), ("<div>" * 3000 + "deep", "deep"), ("<p>x</p>" * 3000, "\n".join(["x"] * 3000)),
])
def test_odd_pages(page, text):
    assert hw.main_text(page, hw.page_wrapper(page or "")) == text


def test_wrapper_inference():
    a = hw.page_wrapper("<div>Fixed</div><ul><li>1</li></ul><p>x</p>")
    b = hw.page_wrapper("<div>Fixed</div><ul><li>1</li><li>2</li></ul><h2>s</h2><p>y</p><p>z</p>")
    w = hw.merged(a, b)
    assert hw.expression(w) == "<div>Fixed</div><ul>(<li>(#TEXT)+</li>)+</ul>(<h2>s</h2>)?(<p>(#TEXT)+</p>)+" or (
        hw.expression(w) == "<div>Fixed</div><ul>(<li>#TEXT</li>)+</ul>(<h2>s</h2>)?(<p>#TEXT</p>)+")
    assert hw.expression(hw.merged(b, a)).startswith("<div>Fixed</div>")


def test_template_text_goes_without_semantic_tags(spark):
    rows = [(n, f"http://h.example/{n}", f"<div id=top><b>My Site</b></div><div id=text{n}><p>story {n} is told here</p></div><div id=end>All rights</div>")
            for n in range(40)]
    rows += [(50, "http://other.example/", "<div>My Site</div>"), (51, None, "<p>x</p>"), (52, "http://h.example/e", None),
             (0, *rows[0][1:])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    for parts in (1, 9):
        out = hw.extract(pages.repartition(parts)).collect()
        got = {r._page: r.text for r in out}
        assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
        assert got == {n: f"story {n} is told here" for n in range(40)} | {50: "My Site", 51: "x", 52: ""}
    assert hw.extract(pages.limit(0)).collect() == []


def test_query_against_plain_reading(spark):
    """The table's pages hold the article between two tags, with headings, paragraphs and line breaks."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    out = queries.op6_html(spark, SF01).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split())
                  for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.url == pages[r.page_id].url


def test_template_text_goes_inside_articles(spark):
    """Notices of no listed class, long and short, in bare and in own elements, and below 48 levels."""
    long, deep = "terms " * 60, "<div>" * 60
    rows = [(n, f"http://{tag}.example/{n}", f"<{tag}><p class=zq>Read more of our stories</p><h1>Head {n}</h1><p>told {n}</p>"
             f"{'<p>more</p>' * (n % 3)}<p>second {n}</p><p>Send this to a friend</p><p class=zz>{long}</p>"
             f"{deep}<i class=zd>deep notice</i>{'</div>' * 60}{'<b class=zo>Only here</b>' if n == 4 else ''}</{tag}>")
            for tag in ("article", "main") for n in range(12)]
    copy = "".join(f"<p>{'long ' * 9}{k}</p>" for k in range(5))
    # Versions of one article, and a host of two pages tell nothing.
    rows += [(100 + n, "http://copy.example/", f"<article><h1>Head</h1>{copy}<p class=v>v {n}</p></article>") for n in range(9)]
    rows += [(200 + n, "http://two.example/", f"<article><h1>H</h1><p>text {n}</p></article>") for n in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        got = {(r._page, r._url): r.text.split("\n") for r in hw.extract(pages.repartition(parts)).collect()}
        for n, url, _ in rows:
            text = got[n, url]
            if n < 100:
                assert text == [f"Head {n}", f"told {n}", *["more"] * (n % 3), f"second {n}"] + ["Only here"] * (n == 4)
            elif n < 200:
                assert text == ["Head", *(f"{'long ' * 9}{k}" for k in range(5)), f"v {n - 100}"]
            else:
                assert text == ["H", f"text {n - 200}"]


def test_headings_of_a_host_stay_over_own_text(spark):
    """Sections named alike on all pages are content; a heading over template lines goes with them."""
    rows = [(n, f"http://h.example/{n}", f"<article><h1>Land {n}</h1><h2>History</h2><p>founded {n}</p><h2>Economy</h2>"
             f"<p>trade {n}</p><p>goods {n}</p><h3>About us</h3><p class=zq>We write of lands</p></article>") for n in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in hw.extract(pages).collect():
        n = r._page
        assert r.text == f"Land {n}\nHistory\nfounded {n}\nEconomy\ntrade {n}\ngoods {n}"


@pytest.mark.parametrize("page, text", [
    ('<p><a title="foo>bar</a> next</p>', "bar next"), ("<p>a <b title='x>y</p><p>z</p>", "a y\nz"),
    ('<p title="a>b" lang=\'c>d\'>q</p>', "q"), ('<p>x <a href="u" title="v">y</a></p>', "x y"),
    ("<p>1 < 2 <3 <é</p>", "1 < 2 <3 <é"), ("<p>x<a", "x<a"), ("<p>x<a b='c", "x<a b='c"), ("<br/>a<script/>b", "ab")])
def test_quotes_and_broken_tags(page, text):
    assert hw.main_text(page) == text


@pytest.mark.parametrize("part", ["<a b ", '<a b="', '<a ">" ', "<a '\"> ", "<", "<!", "<p \"'>", "</a '"])
def test_time_is_linear_in_broken_tags(part):
    import time

    def seconds(size):
        page = part * (size // len(part))
        start = time.perf_counter()
        for _ in hw.tokens(page):
            pass
        return time.perf_counter() - start

    assert seconds(1_000_000) < 100 * max(seconds(50_000), 0.01)  # 20 times the size: 400 if quadratic


def test_wrapper_survives_packing():
    page = "<div>" * 5000 + "deep" + "x" * 300
    w = hw.page_wrapper(page)
    assert hw.packed(hw.unpacked(hw.packed(w))) == hw.packed(hw.merged(w, w)) == hw.packed(w)
    assert hw.expression(w).count("<div>") == 5000
