"""Template deduction: planted sites with known texts, plain versions of what is added up, odd markup."""

import html as entities
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from echogrid.llm import queries, templates
from echogrid.llm.markup import Names, Page

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def text_of(html):
    page = Page(html, Names())
    return page.text([not m for m in page.mark])


def test_articles_of_the_given_pages(spark):
    """There each article is marked, so a pattern finds what is wanted."""
    got = {r.page_id: r for r in queries.op13_html_extraction(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a<b>b<p>c</b>d", "ab\ncd"),
        ("<ul><li>x<li>y<ul><li>z</ul>w</ul>q", "x\ny\nz\nw\nq"),
        ("<table><tr><td>1<td>2<tr><td><p>3</table>t", "1 2\n3\nt"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
        ("<div<div<div", ""),
        ("x < y & z &lt;i&gt; &#x41; &eacute;&amp;", "x < y & z <i> A é&"),
        ("a<script>var s = '</p>';</SCRIPT >b<style>p{}</style>c", "abc"),
        ("<script>never ends <p>x", ""),
        ("<!-- a --><p>q<!-->r<!-- <p>hidden</p> --!>s<!-- open", "qrs"),
        ("<body><form><h1>T</h1><p>u</form>", "T\nu"),
        ("<form><p>name <input></form><p>u", "u"),
        ("<article><header><h1>T</h1></header>y<footer>z</footer></article><header>site</header>", "T\ny"),
        ("<div class='comments'><article class=comment>x</article></div><article>y</article>", "y"),
        ('<a href="x>y" title=it\'s>k</a>l<br>m<wbr>n', "kl mn"),
        ("<div hidden>a</div><div style='Display: none'>b</div><p aria-hidden=true>c<p class='has-sidebar'>d", "d"),
        ("<div id=cookieNotice>a</div><div class='top-ad x'>b</div><div class=readable>c</div>", "c"),
        ("<head><title>t</title>text<p>u</p></body></html>v", "text\nu\nv"),
        ("<b><div>in</b>out</div><p>  a\n b\t</p>", "inout\na b"),
        ("<noscript><p>x</noscript>y", "y"),
        (None, ""),
        ("", ""),
    ],
)
def test_markup(html, text):
    assert text_of(html) == text


def test_markup_in_linear_time():
    import time

    names, began = Names(), time.perf_counter()
    for part in ("<div><span>", "<p>", "<li>", '<a b="', "<b></p></div>", "<table><td>", "&", "<!--", "<p><b>", "<ul><li></ul>"):
        Page(part * 50_000, names)
    assert time.perf_counter() - began < 30


def site(host, n, layout, words="river hill stone meadow cloud harbour window garden letter morning".split()):
    """Pages of a site without telling names, and their texts."""
    out = []
    for i in range(n):
        body = [f"Story {i} of {host}", *[" ".join(words[(i * 7 + j * 3 + k * k) % len(words)] + str((i * 31 + j * k) % 97) for k in range(20)) + "." for j in range(1 + i % 4)]]
        out.append((i, f"https://{host}/s/{i}", layout(i, body), "\n".join(body)))
    return out


def soup(i, body):
    return f"<html><body><div class=x1><p>All visitors see this long line about the rules of the house, which never changes.</p></div><div class=x2><a href=/a{i}>News {i}</a> <a href=/b>Sport</a></div><div class=x3><h2>{body[0]}</h2><div class=x6>Print | Send</div>{''.join(f'<p>{b}</p>' for b in body[1:])}<ul class=x7><li><a href=/{i}>More of number {i}</a><li><a href=/{i + 1}>Also read {i + 1}</a></ul></div><div class=x5>Made by hand in the valley</div></body></html>"


def test_slots_of_pages_without_telling_names(spark):
    """Constant notices, links and parts inside the slot go by the template alone; equal paragraphs on many pages stay."""
    rows = site("soup.example", 30, soup)
    same = [(100 + i, f"https://soup.example/c/{i}", soup(i, ["Copied story", "This whole paragraph is the same on a third of all pages of the site."]), "Copied story\nThis whole paragraph is the same on a third of all pages of the site.") for i in range(15)]
    rows += same
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame([r[:3] for r in rows], PAGES).repartition(4)).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_one_page_alone(spark):
    """No template: article, main, or what isn't boilerplate by name, without lists of links."""
    lone = "<body><div class=menu>Home</div><div>A text that stands alone.</div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul></body>"
    df = spark.createDataFrame([(1, "http://one.example/", lone), (2, None, "<main>m</main>n"), (3, "http://two.example/", None), (3, "http://two.example/", None), (None, "nonsense", "")], PAGES)
    df = df.withColumns({c: F.lit("x") for c in ("host", "token", "text", "n_chars", "valid", "tag")})
    got = sorted([tuple(r) for r in templates.extract(df).collect()], key=str)
    assert got == sorted([(1, "http://one.example/", "A text that stands alone.", 25), (2, None, "m", 1), (3, "http://two.example/", "", 0), (3, "http://two.example/", "", 0), (None, "nonsense", "", 0)], key=str)
    none = templates.extract(df.limit(0))
    assert none.collect() == [] and none.columns == ["page_id", "url", "text", "n_chars"]


def test_classes_are_those_of_plain_vectors(spark):
    """Tokens with equal fingerprints are those with equal occurrence vectors."""
    rows = site("soup.example", 12, soup) + [(50, "https://soup.example/odd", "<body><div class=x5>w</div><div class=x3><p>v</p></div></body>", "")]
    df = spark.createDataFrame([r[:3] for r in rows], PAGES).repartition(3)
    vectors, names = defaultdict(dict), Names()
    for n, r in enumerate(rows):
        for token, k in Counter(t for t, _, _ in templates._sequence(Page(r[2], names))).items():
            vectors[token][n] = k
    want = defaultdict(set)
    for token, v in vectors.items():
        if len(v) >= templates.SUPPORT:
            want[tuple(sorted(v.items()))].add(token)
    got = defaultdict(set)
    for r in templates.frequent(templates.tokens(df)).collect():
        got[r.class_id].add(r.token)
        assert r.support == len(vectors[r.token]) and r.occurrences == sum(vectors[r.token].values())
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_classes_that_pages_break_are_invalid(spark):
    """Two elements that are on the same pages as often, but change places, are no class of the template."""
    swap = lambda i: f"<body><div class=top>t{i}</div>" + ("<div class=p1>a</div><div class=p2>b</div>" if i % 2 else "<div class=p2>b</div><div class=p1>a</div>") + "</body>"
    whole = lambda i: f"<body><div class=top>t{i}</div><div class=p1>a</div><div class=p2>b</div></body>"
    for page, n_broken in ((swap, 1), (whole, 0)):
        df = spark.createDataFrame([(i, "http://s.example/", page(i)) for i in range(8)], PAGES)
        often = templates.frequent(templates.tokens(df))
        classes = often.where("members > 1").groupBy("host").applyInArrow(lambda t: templates._ordered(t), templates.CLASSES)
        assert templates.invalid(df, classes).count() == n_broken


def test_templates_beyond_the_broadcast(spark, monkeypatch):
    """Hosts with many pages are broadcast, the others joined: the same texts."""
    rows = site("a.example", 12, soup) + [(200 + i, u, h, t) for i, u, h, t in site("b.example", 4, soup)]
    df = spark.createDataFrame([r[:3] for r in rows], PAGES)
    monkeypatch.setattr(templates, "MAX_BROADCAST", 0)
    monkeypatch.setattr(templates, "HOT", 10)
    assert {r.page_id: r.text for r in templates.extract(df).collect()} == {r[0]: r[3] for r in rows}
