"""Expressions against the rules they stand for."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadweave.functions import classify as C
from leadweave.functions import contact as E
from leadweave.functions import html as H
from leadweave.functions import names as N
from leadweave.functions import url as U


@pytest.fixture(scope="module")
def of(spark):
    def run(f, values, kind="string"):
        d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r.y for r in d.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def test_canonical(of):
    u = ["https://Example.com/", "https://www.example.com", "https://example.com?utm_source=google", "https://example.com/page/", "HTTP://a.B/c?z=1&b=2&b=1&e=&ref=x#top", "https://a.b/?q=x%20y", " nonsense ", None]
    assert of(U.canonical, u) == ["https://example.com"] * 3 + ["https://example.com/page", "http://a.b/c?b=1&b=2&z=1", "https://a.b?q=x y", "nonsense", None]
    assert of(U.crawl_canonical, ["http://www.Example.com/A/?b=1&page=2&lang=EN#x", "", None, "ftp://x/"]) == ["https://example.com/a?page=2&lang=en", "", "", "ftp://x"]
    assert of(U.lead_domain, ["https://www.Example.com:80/x", "example.com", "http://a.www.b.com"]) == ["example.com:80", "example.com", "a.b.com"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abAB/?&=#.:%w ", max_size=30), min_size=1, max_size=20))
def test_canonical_forms_are_fixed_points(of, urls):
    urls = ["https://www.h.com/" + u.replace("%", "") for u in urls]
    for f in (U.canonical, U.crawl_canonical):
        once = of(f, urls)
        plain = [(a, b) for a, b in zip(once, of(f, once)) if " " not in a]
        assert all(a == b for a, b in plain)


def test_hosts(of):
    assert of(U.domain_token, ["www.acme.co.uk", "acme.com", "a.b.acme.org", "localhost"]) == ["acme", "acme", "acme", "localhost"]
    assert of(U.base_domain, ["x.acme.co.uk", "x.acme.com", "acme.com"]) == ["acme.co.uk", "acme.com", "acme.com"]
    assert of(U.cache_key, ["https://www.acme.com/x", "https://linkedin.com/company/A"]) == ["acme.com", "https://linkedin.com/company/a"]
    assert of(U.unwrapped, ["/url?q=https%3A%2F%2Fa.com%2F&x=1", "/url?sa=t&q=https://a.com/", "https://g.com/url?q=https%3A%2F%2Fa.com%2F", "https://b.com/?q=x", "/search?q=https://a.com", " https://c.com/ ", "mailto:x"]) == ["https://a.com/", "https://a.com/", "https://g.com/url?q=https%3A%2F%2Fa.com%2F", "https://b.com/?q=x", None, "https://c.com/", None]
    assert of(U.unwrapped_code, ["https://b.com/ck?u=a1aHR0cHM6Ly9hLmNvbS8", "https://b.com/ck?x=1&u=aHR0cHM6Ly9hLmNvbS8&y", "/ck?u=a1aHR0cHM6Ly9hLmNvbS8", "https://b.com/?u=john", "https://c.com/", "/x"]) == ["https://a.com/", "https://a.com/", "https://a.com/", "https://b.com/?u=john", "https://c.com/", None]
    assert of(lambda u: F.concat(u, F.lit("")), ["https://c.com/"]) == ["https://c.com/"]
    assert of(U.is_valid_result, ["https://a.com/x", "ftp://a.com", "https://a", "https://a.com/search?q", "https://a .com", None, "https://www.google.com/x"]) == [True, False, False, False, False, False, False]
    assert of(U.is_government, ["https://x.gov", "http://a.gov.in/x", "https://a.govt.nz", "https://gov.example.com", "https://govern.com", "https://x.mil", None]) == [True, True, True, True, False, False, False]
    assert of(U.is_forum, ["https://www.reddit.com/r", "https://medium.com/a", "https://acme.com/?u=dev.to", "https://acme.com/forum", None]) == [True, True, True, False, False]
    assert of(U.domain_token, ["foo.co.com", "www.acme.co.in", ""]) == ["co", "acme", ""]


def test_emails(of):
    assert of(E.email_status, ["logo@2x.png", "u003einfo@example.com", "info@example", "your@email.com", "noreply@a.com", " a+b@example.com "]) == ["junk", "ok", "malformed", "junk", "junk", "ok"]
    assert of(E.unescaped_email, ["u003einfo@example.com"]) == ["info@example.com"]
    assert of(E.merge_emails, [["A+b@example.com", " C@D.com "]], "array<string>") == [["c@d.com"]]
    assert of(E.ranked_emails, [["zed@a.com", "info@a.com", "noreply@a.com", "ceo@a.com", "info@a.com"]], "array<string>") == [["ceo@a.com", "info@a.com", "zed@a.com"]]


def test_phones(of):
    good = ["+911234567890", "+1 877.319.9304", "9876543210", "011-27871018", "(408)5551234"]
    bad = ["12.05.2024", "2025-2026", "1950 - 1999", "10.30-12.00", "2026", "20260705", "12-34", "1234\n5678901", "", None, "1234567890123456"]
    assert of(E.is_phone, good + bad) == [True] * 5 + [False] * 11
    assert of(E.phones_in, ["call +1 (212) 555-0199, 12.05.2024 or +1 (212) 555-0199", "(212) 555-0199", "12 34\n567 890", "a (02)\t1234567"]) == [["+1 (212) 555-0199"], ["(212) 555-0199"], [], ["(02)\t1234567"]]
    assert of(E.merge_phones, [["(212) 555-0199", "12"]], "array<string>") == [["2125550199"]]


def test_people_and_names(of):
    assert of(E.is_person, ["Ann Example", "by Ann Example", "Certificate", "Ann", "Ann B2", "A: B", None, "One Two Three Four Five Six", "Best College Ever"]) == [True, True, False, False, False, False, False, False, False]
    assert of(N.company_name, ["Acme Pvt. Ltd.", "Acme India Inc", "  Acme,  Corp. ", "Co", None, "Acme Global", "Global Acme"]) == ["Acme", "Acme", "Acme", "Co", "", "Acme", "Global Acme"]
    assert of(N.name_key, ["Acme-X Pvt. Ltd."]) == ["acmex"]
    titles = ["e-commerce o'neil ai/ml", "AI", "x y", "", "a1b"]
    assert of(N.title_case, titles) == [t.title() for t in titles]
    assert of(N.industry, ["it", "soft ware"]) == ["IT", "Soft Ware"]
    assert of(lambda c: N.slug(c, "-"), ["  Acme & Sons "]) == ["acme-sons"]
    assert of(N.without_repeats, ["company Company a b b"]) == ["company a b"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abAB-'./ 12", max_size=20), min_size=1, max_size=20))
def test_title_case_is_pythons(of, texts):
    assert of(N.title_case, texts) == [t.title() for t in texts]


def test_page_types(spark):
    cases = {
        "https://clutch.co/profile/acme": "COMPANY_PROFILE", "https://clutch.co/directory/x": "DIRECTORY_LIST", "https://en.wikipedia.org/wiki/X": "ARTICLE", "https://acme.com/": "COMPANY_HOMEPAGE", "https://acme.com/blog/x": "BLOG",
        "https://acme.com/careers/": "CAREERS", "https://acme.com/jobs/12": "JOB_POSTING", "https://docs.acme.com/x": "DOCUMENTATION", "https://github.com/acme": "COMPANY_PROFILE", "https://github.com/pricing": "UNKNOWN", "https://linkedin.com/company/a": "COMPANY_PROFILE",
        "https://facebook.com/a": "SOCIAL", "https://stackoverflow.com/q": "FORUM", "https://forbes.com/x": "NEWS", "https://acme.com/x/y": "UNKNOWN", "https://acme.com/top-ten": "DIRECTORY_LIST", "https://play.google.com/store": "MARKETPLACE",
    }
    d = spark.createDataFrame([(u, "") for u in cases], "url string, title string")
    got = {r.url: (r.k, r.c) for r in d.select("url", C.page_type(F.col("url"), F.col("title"))["kind"].alias("k"), C.result_class(F.col("url"), F.col("title")).alias("c")).collect()}
    assert {u: k for u, (k, _) in got.items()} == cases
    assert got["https://clutch.co/directory/x"][1] == "DIRECTORY_LIST" and got["https://acme.com/"][1] == "ALLOW" and got["https://en.wikipedia.org/wiki/X"][1] == "REJECT" and got["https://acme.com/x/y"][1] == "UNKNOWN"


def test_scores(of, spark):
    assert of(C.query_intent, ['site:linkedin.com "founder"', "software companies pune", "how to learn python", "acme"]) == ["HIGH", "MEDIUM", "LOW", "LOW"]
    assert of(C.decision_maker, ["Co-Founder & CEO", "Managing Director", "director of x", "intern", "", None]) == [95, 85, 70, 20, 0, 0]
    assert of(lambda c: C.quality_penalty(c), ["college blog", "rankings"]) == [55, 60]
    assert of(C.source_score, ["LinkedIn", " clutch", "?", None]) == [95, 90, 70, 70]
    assert of(C.quality_label, [70, 69, 40, 39], "int") == ["High", "Medium", "Medium", "Low"]
    assert of(C.is_listing, ["", None, "Top 10 widget companies in Springfield", "Acme"]) == [True, True, True, False]
    one = spark.range(1).select(C.completeness(F.lit("w"), F.lit(None), F.lit("a"), F.lit(""), F.lit("t"), F.array(F.lit("e")), F.array().cast("array<string>"), F.lit(90), F.lit("clutch"), F.lit(55)).alias("s")).first().s
    assert one == round(15 + 5 + 5 + 10 + 13.5 + 13.5 + 4.5)


def test_html(spark):
    page = """<html><head><title>Acme</title><meta name="description" content="We make"><script type="application/ld+json">{"@graph": [{"@type": "Organization", "email": "mailto:a@acme.com", "telephone": "+1 212 555 0199"}]}</script></head>
    <body><h1>Hello</h1><a href="mailto:Sales%40acme.com?x">mail</a><a href="/careers#x">Careers</a><a href="https://www.linkedin.com/company/acme">in</a><p>Ann Example</p><p>Chief, CEO</p><footer>© <a href="/contact">Contact</a></footer></body></html>"""
    d = spark.createDataFrame([("https://acme.com/a/b", page), ("https://acme.com", None)], "url string, html string").select("url", H.parsed(F.col("html"), F.col("url")).alias("p"))
    got = d.select("p.title", "p.description", "p.headings", H.page_emails(F.col("p")).alias("emails"), H.page_phones(F.col("p")).alias("phones"), H.subpages(F.col("p")).alias("sub"), H.social_links(F.col("p")).alias("social"), H.footer_links(F.col("p")).alias("foot"), H.people(F.col("p")).alias("people"), H.homepage_score(F.col("p")).alias("score")).collect()
    r = got[0]
    assert (r.title, r.description, r.headings, r.emails, r.phones) == ("Acme", "We make", ["Hello"], ["sales@acme.com", "a@acme.com"], ["+1 212 555 0199"])
    assert r["sub"] == {"contact_page": "https://acme.com/contact", "careers_page": "https://acme.com/careers#x"} and r.foot == ["https://acme.com/contact"]
    assert r.social == {"linkedin.com": "https://www.linkedin.com/company/acme"} and [(p.name, p.designation) for p in r.people] == [("Ann Example", "CEO")]
    assert r.score == 20 + 15 + 20 + 10 and got[1].score == 0 and got[1].emails == []


def test_links_and_people_by_rule(spark):
    """Footers by class and id, own host, the page itself, other words, networks by domain, people by block order."""
    page = """<body><div id="team"><h3>Ann Example</h3><span>Co-Founder and CEO</span><p>A long story. %s CEO</p></div><h4>Bob Q. Sample</h4><p>vp of sales</p><p>Our Blog</p><p>director</p><p>Head of things</p>
    <a href="/">Company home</a><a href="https://other.com/about">About</a><a href="who-we-are?x=1#y">Us</a><a href="../Board">Board</a><a href="//acme.com/data-protection">D</a><a href="/work-with-us">W</a><a href="/about">later</a>
    <a href="https://m.x.com/acme">x</a><a href="https://facebook.com/a?b=1">f</a><a href="https://www.facebook.com/b">f2</a><a href="https://youtube.com/c">y</a><a href="http://[bad">bad</a>
    <div class="site footer"><a href="/help#a">H</a><section><a href="/x">Get support</a></section><a href="/y">Terms</a><a href="https://z.com/contact">c</a></div><div id="FooterBox"><a href="/reach">r</a><a href="/help#a">H</a></div><div class="footers"><a href="/info">i</a></div></body>""" % ("x" * 120)
    d = spark.createDataFrame([("https://acme.com/a/", page)], "url string, html string").select(H.parsed(F.col("html"), F.col("url")).alias("p"))
    r = d.select(H.subpages(F.col("p")).alias("sub"), H.social_links(F.col("p")).alias("social"), H.footer_links(F.col("p")).alias("foot"), H.people(F.col("p")).alias("people")).first()
    assert r["sub"] == {"about_page": "https://acme.com/", "team_page": "https://acme.com/Board", "careers_page": "https://acme.com/work-with-us", "privacy_page": "https://acme.com/data-protection"}
    assert r.social == {"x.com": "https://m.x.com/acme", "facebook.com": "https://facebook.com/a?b=1"}
    assert r.foot == ["https://acme.com/help#a", "https://acme.com/x", "https://acme.com/reach"]
    assert [(p.name, p.designation) for p in r.people] == [("Ann Example", "Founder"), ("Bob Q. Sample", "VP"), ("director", "Head Of")][:2]


def test_homepage_in_exact_mode(spark):
    page = "<title>Acme Robotics</title><body><a href='/contact'>Contact</a><a href='/about'>About</a><a href='/products'>P</a><p>a@b.com copyright</p></body>"
    d = spark.createDataFrame([(page, "robotics"), (page, "chemistry"), (page, ""), ("", "robotics"), (None, "x")], "html string, k string")
    got = d.select(H.homepage_verdict(F.col("html"), H.parsed(F.col("html")), F.col("k")).alias("exact"), H.homepage_verdict(F.col("html"), H.parsed(F.col("html"))).alias("any")).collect()
    assert [(r.exact, r["any"]) for r in got] == [("ALLOW", "ALLOW"), ("REJECT", "ALLOW"), ("ALLOW", "ALLOW"), ("REJECT", "REJECT"), ("REJECT", "REJECT")]
