"""HTML extraction: the reader on awkward markup, the network's sums and gradients, pages of many layouts."""

import html as html_lib
import re

import numpy as np
import pytest

from leadweave.llm import html_extraction as H
from leadweave.llm.html_blocks import bit, blocks_of

SF = "/root/testdata/sf0.001"


def texts(page):
    return blocks_of(page).texts


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x>y">The</a><li><a href=/>and</a></ul></nav>
    <!-- <p>no</p> --><p>foo<i>bar</i><br>x  y\n<p>1 < 2 &amp;&lt;b&gt; &eacute;&#233;&copy 3<textarea>no</textarea><td>cell<footer title='a>b'>foot</footer>end"""
    assert texts(page) == ["The", "and", "foobar x y", "1 < 2 &<b> éé© 3", "cell", "foot", "end"]
    assert blocks_of(page).linked[:3] == [3, 3, 0]
    for cut, want in (("", []), ("plain", ["plain"]), ("<p", []), ("<p class='x", []), ("a<script>b", ["a"]), ("<!--x", []), ("<>a</>b</p>c", ["<>ab", "c"]), ("<p x=\"1>a</p><p>b", ["a", "b"]), ("&am<b>p;</b>", ["&amp;"])):
        assert texts(cut) == want, cut
    assert texts("<p don't>it's</p>") == ["it's"]


def test_paths():
    b = blocks_of('<div class="siteHeader top-bar" id=x><p>a</p></div><p>b<table><tr><td>c<td>d</table>e</div>')
    bits = [b.bits[p] for p in b.paths]
    assert b.texts == ["a", "b", "c", "d", "e"]
    assert all(bits[0] & bit(t) for t in ("div", ".site", ".header", ".top", ".bar", ".x", "p", "@p")) and not bits[0] & bit("table")
    assert bits[1] & bit("p") and not bits[1] & bit("div")
    assert bits[2] == bits[3] and bits[2] & bit("@td") and not bits[4] & bit("table")


@pytest.mark.parametrize("page", ['<a href="' * 50_000, "<!--" * 50_000, "<p>x" * 50_000, "<div>" * 50_000 + "</p>" * 50_000 + "x", "<" * 50_000, "<b>" * 30_000 + "</i>" * 30_000 + "x", "<p x='>" * 30_000, "x " * 200_000])
def test_long_and_broken_pages_end(page):
    b = blocks_of(page)
    assert len(b.texts) == len(b.paths) == len(b.linked)


def made(keys):
    return [p for k in keys for p in H.training_pages("", k, 6)]


def test_gradients():
    pages = made([1])[:5]
    x, y = H.inputs_of([b for b, _ in pages]), np.concatenate([y for _, y in pages]).astype(float)
    m = H.Labeller.fresh(3)
    for n in ("w", "u", "b", "v", "c"):
        setattr(m, n, getattr(m, n).astype(np.float64))
    dense = x.rows(np.arange(len(x.path))).astype(np.float64)
    g = H._gradients(m, dense, x.each, y)

    def loss():
        p = m.probabilities(x).astype(np.float64)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    r = np.random.default_rng(0)
    for n in ("w", "u", "b", "v", "c"):
        a = getattr(m, n)
        for at in [np.unravel_index(int(np.abs(g[n]).argmax()), a.shape), tuple(r.integers(0, s) for s in a.shape)]:
            old, step = a[at], 1e-2
            a[at] = old + step
            up = loss()
            a[at] = old - step
            down = loss()
            a[at] = old
            assert abs((up - down) / (2 * step) - g[n][at]) < 2e-4, (n, at)


def test_stretches_and_neighbours_change_nothing(monkeypatch):
    pages = [b for b, _ in made([2, 3])]
    m = H.Labeller.fresh(5)
    whole = m.probabilities(H.inputs_of(pages))
    monkeypatch.setattr(H, "STEPS", 3)
    assert np.allclose(whole, m.probabilities(H.inputs_of(pages)), atol=1e-5)
    alone = np.concatenate([m.probabilities(H.inputs_of([b])) for b in pages])
    assert np.allclose(whole, alone, atol=1e-5)


def plain(page):
    """The article of the given pages, whose layout is known."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", inner)
    clean = (re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in parts)
    return " ".join(c for c in clean if c)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def labeller(given):
    return H.fit(given)


def test_query_equals_plain(spark, given):
    d = H.op11_html_extraction(spark, SF)
    assert d.dtypes[:4] == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    got = {r.page_id: r for r in d.collect()}
    pages = given.collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, plain(p.html), len(plain(p.html)))


TEXT = "<p>Rémentir qui la queelle elleeau de viment éoion les oupa ieren anéoi vire, antreeau un one pa eux.</p><p>Leéeux, leê lement reeux de. Avec euxç ououé et ouan queeau équech.</p><p>Short one.</p>"
LAYOUTS = [
    f'<header><h1>My Site</h1><nav><a href=/>Home</a> <a href=/b>Blog</a></nav></header><main><article><h1>Good title</h1>{TEXT}<aside>Bad: <a href=x>foo</a></aside>{TEXT}<section class="comments"><h3>2 bad comments</h3><div class="comment"><p>I like the bad queelle elleeau de viment.</p></div><form><label>Bad name</label><button>Bad</button></form></section></article></main><footer><p>© Bad Inc.</p></footer>',
    f'<div id="header">Bad site</div><div id="nav"><ul><li><a href=a>Bad</a></li><li><a href=b>Bad B</a></li></ul></div><div class="cookie-banner">We use bad cookies.</div><div id="content"><h2>Good title</h2>{TEXT}<div class="ad">Buy this bad queelle elleeau!</div>{TEXT}<ul><li>good item of list</li><li>second good item</li></ul></div><div id="sidebar"><p>Bad text de viment éoion les oupa ieren.</p></div><div id="comments"><div><p>Bad {TEXT}</p></div></div><div id="footer">Bad Copyright</div>',
    f'<table><tr><td class="menu"><a href=a>Bad Home</a><br><a href=b>News</a></td><td class="content"><h1>Good T</h1>{TEXT}</td></tr><tr><td class="footer">Bad Legal text</td></tr></table>',
    f'<div class="xq wrapper"><div class="breadcrumb"><a href=/>Bad</a> &gt; <a href=/x>X</a></div><div class="post"><div class="entry-content">{TEXT}<div class="share-buttons"><a href=1>Bad</a></div><div class="newsletter-signup"><p>Sign up for our bad newsletter</p></div>{TEXT}</div></div><div class="related-posts"><p>Another bad story de viment éoion les oupa ieren</p></div></div>',
]


def test_layouts_of_other_sites(labeller):
    wrong = total = 0
    for page in LAYOUTS:
        b = blocks_of(page)
        bad = {i for i, t in enumerate(b.texts) if "bad" in t.lower() or t in ("My Site", "Home Blog") or (b.bits[b.paths[i]] & bit(".comments"))}
        p = labeller.probabilities(H.inputs_of([b]))
        wrong, total = wrong + sum((q >= 0.5) == (i in bad) for i, q in enumerate(p)), total + len(p)
        ((text, n),) = H.main_text([b], labeller)
        assert text == " ".join(t for t, q in zip(b.texts, p) if q >= 0.5) and n == sum(p >= 0.5)
    assert wrong <= 1 and total > 40


def test_held_out_layouts(labeller, given):
    """Known labels of layouts of pages that the sample lacks: their own texts, seeds and names."""
    right = total = 0
    for k, r in enumerate(given.orderBy("page_id").limit(40).collect()):
        pages = H.training_pages(r.html, 10**6 + 17 * k, 6)
        p = labeller.probabilities(H.inputs_of([b for b, _ in pages]))
        y = np.concatenate([y for _, y in pages])
        right, total = right + int(((p >= 0.5) == y).sum()), total + len(y)
    assert right / total > 0.97


def test_rows(spark, labeller):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<article><p>" + "Some words of an article here, as usual. " * 3), (3, "u", "<nav><a>x</a></nav>"), (4, "v", "<article>" + "<p>One of many paragraphs, and not the last one." * 30_000), (3, "u", "<nav><a>x</a></nav>")]
    t = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, HTML string, text int").repartition(3)
    got = H.extract(t, labeller).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and (by[1].text, by[1].n_chars, by[1].url, by[2].text, by[3].text) == ("", 0, None, "", "")
    assert by[None].text == ("Some words of an article here, as usual. " * 3).strip() and by[None].n_chars == len(by[None].text)
    assert by[4].n_blocks == 30_000 and by[4].n_kept > 29_000
    assert H.extract(t.limit(0), labeller).count() == 0
    none = H.fit(t.filter("page_id = 1"))
    assert H.extract(t.filter("page_id = 1"), none).first().text == ""
