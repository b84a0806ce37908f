"""Main text of pages."""

import random
from collections import Counter

import pytest

from lodestar.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">home</a><li>about</ul></nav><!-- ad --><div class="ad">buy</div>
<article><h1>Head &amp; line</h1><p><b>First  part.<br>
more<p>Sec&#246;nd &lt;one&gt;</p><form><input><label>name</label></form><div class="comments"><p>nice</p></div>
<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>{extra}</article><aside>side</aside><footer>foot {n}</footer></body></html>"""
TEXT = "Head & line\nFirst part. more\nSecönd <one>\none\ntwo\na b\nc"


def text_of(page, gone=frozenset()):
    root = html.parse(page)
    html.marked(root)
    return html.main_text(root, gone)


def test_article():
    assert text_of(PAGE.format(extra="", n=1)) == TEXT


@pytest.mark.parametrize(
    "page,expected",
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("a < b & c", "a < b & c"), ("<p>one<p>two", "one\ntwo"), ("<div>x<div>y</div>z</div>", "x\ny\nz"),
        ("<p>a<!-- <p>no --> b", "a b"), ("<script>no</script>yes<style>no", "yes"), ("<P CLASS=Notice>no</P><P>yes", "yes"), ("<p title='a > b'>q</p>", "q"),
        ("<p>unclosed <b>bold", "unclosed bold"), ("</div></p>x", "x"), ("<p>one</div>two</p>", "onetwo"), ("<main><p>in</p></main><p>out</p>", "in"), ("<div role=navigation>no</div><p>yes</p>", "yes"),
        ("<article><p>in<article class=comment>reply</article></article><p>out", "in"), ("<p>&nbsp;a&nbsp;&nbsp;b&#x20;</p>", "a b"), ("<textarea><p>no</textarea><p>yes", "yes"), ("<img alt='x'><br/>t<p/>u", "t\nu"),
        ("<div class='header'>no</div><div class='reader'>yes</div>", "yes"), ("<a><b><i>x", "x"), ("<", "<"), ("<p", ""), ("&amp;lt;", "&lt;"),
        ("<div class='page with-sidebar'><article class='post no-ads'><p>yes</p></article><div class=sidebar>no</div></div>", "yes"), ("<div class=comments><article class=comment>no</article></div><article>yes</article>", "yes"),
    ],
)
def test_markup(page, expected):
    assert text_of(page) == expected


@pytest.mark.parametrize(
    "page,expected",
    [
        ('<div class="page with-sidebar"><p>body</p></div>', "body"), ('<div class="has-menu">a</div><p>b', "a\nb"), ('<p class="search-term">a</p><p>b', "a\nb"),
        ('<section class="feedback-loops">a</section><p>b', "a\nb"), ('<article><h2 id="search">a</h2><p>b', "a\nb"), ('<p>a <span class="social">life</span> b', "a life b"),
        ('<table class="widget-prices"><tr><td>a<td>b</table><p>c', "a b\nc"), ('<article><div class="article-header"><h1>a</h1></div><p>b', "a\nb"), ('<article><p class="notice">a</p><p>bcd', "a\nbcd"),
        ('<div class="sidebar"><p>all that there is</p></div>', "all that there is"), ('<div class="sidebar"><p>most of the text</p></div><p>rest', "most of the text\nrest"),
        ('<div id="site-footer">no</div><p>yes', "yes"), ('<div class="ad-slot-2">no</div><ul class="left nav">no</ul><p>yes</p>', "yes"), ('<article><p>a</p><div class="comments">longer than all of it</div></article>', "a"),
        ('<article><p>abc</p><div class="ad">no</div></article>', "abc"), ('<div class="comments">only readers here</div>', "only readers here"),
    ],
)
def test_names_delete_no_content(page, expected):
    assert text_of(page) == expected


def test_very_long_and_deep_pages():
    assert text_of("<div>" * 20_000 + "x") == "x"
    assert len(text_of("<p>" + "word " * 200_000)) == 999_999
    assert text_of('<p a="' + "x" * 100_000) == ""


def test_hosts():
    cases = {"http://A.example/x": "a.example", "https://u:p@b.example:80?q": "b.example", "//c.example": "c.example", "d.example/x": "", "": "", None: "", "http://[::1]:8/": "[::1]", "http://e.example#f": "e.example"}
    assert {u: html.host_of(u) for u in cases} == cases


def test_subtree_counts_against_a_plain_loop(spark):
    rng = random.Random(4)
    pieces = [f"<div><b>piece {k}</b></div>" for k in range(6)] + [f"<p>said {k}</p>" for k in range(3)]
    rows = []
    for n in range(60):
        own = "".join(f"<p>own {n} {k} {rng.random()}</p>" for k in range(rng.randrange(1, 4)))
        rows.append((n, f"http://h{n % 3}.example/", "".join(rng.sample(pieces, rng.randrange(5))) + rng.choice([f"<article>{own}</article>", f"<div>{own}</div>"])))
    rows += [(100 + k, rows[0][1], rows[0][2]) for k in range(3)]  # copies count once
    pages = spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], SCHEMA)
    found = {(r["host"], m): n for r in html.templates(pages).collect() for m, n in zip(r["marks"], r["n"], strict=True)}
    bodies = {}
    for _, url, page in rows:
        root = html.parse(page)
        html.marked(root)
        marks = sorted(html.candidates(root))
        key = html.host_of(url), html.main_text(root, frozenset())
        bodies[key] = min(bodies.get(key, marks), marks)
    counts, hosts = Counter((h, m) for (h, _), marks in bodies.items() for m in marks), Counter(h for h, _ in bodies)
    assert found and found == {(h, m): n for (h, m), n in counts.items() if n >= html.LEAST_PAGES and n >= hosts[h] * (html.PARAGRAPH_SHARE if m % 2 else html.LEAST_SHARE)}


SCHEMA = "page_id long, url string, html string, host string, marks string, text string"  # clashing names


def run(spark, rows):
    pages = spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], SCHEMA)
    return {r["page_id"]: r["text"] for r in html.extract(pages).collect()}


@pytest.mark.parametrize("few", [100_000, 0])
def test_templates_of_a_host_go(spark, few, monkeypatch):
    """Furniture without any telling name is known by its recurrence; text that is quoted often stays in articles."""
    monkeypatch.setattr(html, "FEW_HOSTS", few)
    page = "<div><div><b>menu of the site</b></div><div><p>text {n}</p><p>often quoted</p></div><div>closing words</div></div>"
    rows = [(n, "http://a.example/", page.format(n=n)) for n in range(10)] + [(20, "http://b.example/", page.format(n=20))]
    rows += [(100 + n, "http://c.example", f"<article><p>text {n}</p><p>often quoted</p><div>our template</div></article>") for n in range(5)]
    found = run(spark, rows)
    assert all(found[n] == f"text {n}" for n in range(10))
    assert found[20] == "menu of the site\ntext 20\noften quoted\nclosing words"
    assert all(found[100 + n] == f"text {n}\noften quoted" for n in range(5))


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://a", ""), (None, "x", "<p>t"), (3, None, "<p>a</p>"), (3, None, "<p>a</p>")]
    pages = spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], SCHEMA)
    got = sorted((r["page_id"] or -1, r["url"] or "", r["text"], r["n_chars"]) for r in html.extract(pages).collect())
    assert got == [(-1, "x", "t", 1), (1, "", "", 0), (2, "http://a", "", 0), (3, "", "a", 1), (3, "", "a", 1)]
    assert html.extract(spark.createDataFrame([], SCHEMA)).collect() == []


LONG, MORE = "the whole story of a day in town", "and what came of it"


@pytest.mark.parametrize("page", ["<div><p>{a}</p><p>{b}</p></div>", "<article><div><p>{a}</p><p>{b}</p></div></article>"])
@pytest.mark.parametrize("foot", ["", "<div>served as {n}</div>"])
def test_copies_of_a_page_keep_their_text(spark, page, foot):
    """Also if a line tells the copies apart, or one menu stands on them and on other pages."""
    menu = "<div><b>home and so on</b></div>"
    rows = [(n, "http://a.example/", menu + (page + foot).format(a=LONG, b=MORE, n=n)) for n in range(3)]
    rows += [(10 + n, "http://a.example/", menu + f"<div><p>text {n} of its own</p></div>") for n in range(5)]
    found = run(spark, rows)
    tail = "\nserved as {}" if foot and "article" not in page else ""
    assert [found[n] for n in range(3)] == [f"{LONG}\n{MORE}" + tail.format(n) for n in range(3)]
    assert [found[10 + n] for n in range(5)] == [f"text {n} of its own" for n in range(5)]


def test_a_quoted_paragraph_stays(spark):
    """Without article and main too, and whole: three of ten pages hold it."""
    rows = [(n, "http://a.example/", f"<div><p>text {n} goes on and on</p>" + ("<p>often <b>quoted</b></p>" if n < 3 else "") + "</div>") for n in range(10)]
    found = run(spark, rows)
    assert [found[n] for n in range(10)] == [f"text {n} goes on and on" + ("\noften quoted" if n < 3 else "") for n in range(10)]
