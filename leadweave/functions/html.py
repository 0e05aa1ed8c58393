"""Page parsing: one Arrow UDF turns HTML into a struct; everything after it is expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from leadweave.functions import classify as C
from leadweave.functions import contact as E
from leadweave.functions import names as N
from leadweave.functions import url as U
from leadweave.functions import values as V

PAGE = (
    "title string, description string, headings array<string>, links array<struct<href:string,text:string,footer:boolean,heading:string,around:string,url:string,host:string>>, blocks array<string>, text string, parts array<string>, base string, host string, "
    "ld_emails array<string>, ld_phones array<string>, body string, lang string, metas array<struct<name:string,content:string>>, classes array<string>, elements int, "
    "ld boolean, schema boolean, footer boolean, ld_text string, ld_items array<struct<url:string,title:string>>"
)
#: Points of homepage signals.
SIGNALS = {"contact": 20, "about": 15, "services": 15, "products": 15, "careers": 15, "privacy": 10}
#: Fields of structured data that describe a company.
LD_FIELDS = ("description", "keywords", "industry", "knowsAbout", "about", "name", "serviceType")
#: Elements that a person's name or title may be the text of; and such as may be a page's footer.
_BLOCKS = {"h1", "h2", "h3", "h4", "p", "span", "div"}
_FOOTERS = {"footer", "div", "section"}
#: Characters of pages that are parsed at once, and an ampersand that begins no reference with a semicolon.
SLICE = 1 << 20
_BARE_AMPERSAND = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


class _Page(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        # A reference counts with its semicolon only: other ampersands are held back as a character that the page lacks.
        self.held = next((c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in html), "") if _BARE_AMPERSAND.search(html) else ""
        self.title, self.description, self.lang, self.ld_text = "", "", "", ""
        self.headings, self.links, self.blocks, self.text, self.body, self.metas, self.ld_items = [], [], [], [], [], [], []
        self.emails, self.phones, self.skip, self.footers, self.open, self.ld, self.item = [], [], 0, [], [], None, None
        self.classes, self.elements, self.has = set(), 0, set()

    def read(self, html: str) -> None:
        self.feed(_BARE_AMPERSAND.sub(self.held, html) if self.held else html)
        self.close()

    def _given(self, text: str) -> str:
        return text.replace(self.held, "&") if self.held else text

    def handle_starttag(self, tag, attrs):
        a = {k: self._given(v or "") for k, v in attrs}
        self.elements += 1
        self.classes.update(a.get("class", "").split())
        if "schema.org" in a.get("itemtype", ""):
            self.has.add("schema")
        if tag in ("html", "body", "footer"):
            self.has.add(tag)
        if tag == "html":
            self.lang = self.lang or a.get("lang", "")
        if tag in ("script", "style"):
            self.skip += 1
            self.ld = [] if tag == "script" and "ld+json" in a.get("type", "") else None
            if self.ld is not None:
                self.has.add("ld")
        elif tag == "meta":
            name = a.get("name") or a.get("property")
            if name:
                self.metas.append((name.lower(), a.get("content", "")))
                if name.lower() == "description" and a.get("name"):
                    self.description = self.description or a.get("content", "")
        elif tag == "a" and a.get("href"):
            around = next((parts for t, parts in reversed(self.open) if t == "div"), None)
            self.links.append([a["href"], "", any(f for _, f in self.footers), "", around])
        if tag in _FOOTERS:
            self.footers.append((tag, tag == "footer" or "footer" in a.get("class", "").lower().split() or "footer" in a.get("id", "").lower()))
        if tag in ("title", "h1", "h2", "h3", "a") or tag in _BLOCKS:
            self.open.append((tag, []))
            if tag in _BLOCKS:
                self.blocks.append(self.open[-1][1])
        self.item = a.get("itemprop")
        if self.item in ("email", "telephone") and a.get("content"):
            (self.emails if self.item == "email" else self.phones).append(a["content"])
            self.item = None

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1
            if self.ld is not None:
                self._ld("".join(self.ld))
                self.ld = None
        if tag in _FOOTERS:
            last = next((i for i in range(len(self.footers) - 1, -1, -1) if self.footers[i][0] == tag), None)
            del self.footers[len(self.footers) if last is None else last :]
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        body = " ".join("".join(self.open[at][1]).split())
        inside = any(t == "a" for t, _ in self.open[:at])
        del self.open[at:]
        if tag == "title":
            self.title = self.title or body
        elif tag in ("h1", "h2") and body and len(self.headings) < 5:
            self.headings.append(body)
        elif tag == "h3" and inside and self.links:
            self.links[-1][3] = self.links[-1][3] or body
        elif tag == "a" and self.links:
            self.links[-1][1] = self.links[-1][1] or body

    def handle_data(self, data):
        data = self._given(data)
        if self.skip:
            if self.ld is not None:
                self.ld.append(data)
            return
        self.text.append(data)
        if "body" in self.has:
            self.body.append(data)
        for _, parts in self.open:
            parts.append(data)
        if self.item in ("email", "telephone") and data.strip():
            (self.emails if self.item == "email" else self.phones).append(data.strip())
            self.item = None

    def _ld(self, raw: str) -> None:
        try:
            data = json.loads(raw)
        except ValueError:
            return
        for entry in data if isinstance(data, list) else [data]:
            if isinstance(entry, dict) and entry.get("@type") == "ItemList":
                items = entry.get("itemListElement", [])
                self.ld_items += [(str(x["url"]), str(x["name"])) for x in items if isinstance(x, dict) and x.get("url") and x.get("name")]
        todo, said = [data], []
        while todo:
            x = todo.pop(0)
            if isinstance(x, dict):
                for k, into in (("email", self.emails), ("telephone", self.phones)):
                    if isinstance(x.get(k), str):
                        into.append(x[k].removeprefix("mailto:"))
                for k in LD_FIELDS:
                    v = x.get(k)
                    v = v.get("name", "") if isinstance(v, dict) else v
                    said += [str(y).strip() for y in (v if isinstance(v, list) else [v]) if isinstance(y, (str, int, float)) and str(y).strip()]
                todo = [*x.values(), *todo]
            elif isinstance(x, list):
                todo = [*x, *todo]
        self.ld_text = " ".join(filter(None, (self.ld_text, " ".join(said))))


def _joined(base: str, href: str) -> tuple[str | None, str | None]:
    """A link as an absolute address, and its host."""
    try:
        url = urljoin(base, href)
        return url, urlsplit(url).netloc.lower()
    except ValueError:
        return None, None


def parse(html: str | None, base: str | None = None) -> dict:
    base = base or ""
    p = _Page(html or "")
    p.read(html or "")
    once = lambda x: list(dict.fromkeys(x))
    plain = lambda parts: " ".join(" ".join(parts).split())
    links = [{"href": h, "text": t, "footer": f, "heading": h3, "around": plain(around or [])[:2000], **dict(zip(("url", "host"), _joined(base, h)))} for h, t, f, h3, around in p.links]
    blocks = [" ".join(filter(None, (x.strip() for x in parts))) for parts in p.blocks]
    return {
        "title": p.title, "description": p.description, "headings": p.headings, "links": links, "blocks": blocks, "text": plain(p.text), "parts": p.text, "base": base, "host": _joined(base, "")[1] or "", "ld_emails": once(p.emails), "ld_phones": once(p.phones),
        "body": plain(p.body), "lang": p.lang or "en", "metas": [{"name": n, "content": c} for n, c in p.metas], "classes": sorted(p.classes)[:20], "elements": p.elements,
        "ld": "ld" in p.has, "schema": "schema" in p.has, "footer": "footer" in p.has, "ld_text": p.ld_text, "ld_items": [{"url": u, "title": t} for u, t in p.ld_items],
    }


def parsed_batches(batches: Iterator[tuple[pa.Array, pa.Array]], kind: pa.StructType) -> Iterator[pa.Array]:
    """Pages and their addresses as structs of the type's fields, a few pages at a time, however many come in a batch."""
    names = [f.name for f in kind]
    for pages, bases in batches:
        rows, held = [], 0
        for h, u in zip(pages, bases):
            h = h.as_py()
            page = parse(h, u.as_py())
            rows.append({n: page[n] for n in names})
            held += len(h or "")
            if held >= SLICE:
                yield pa.array(rows, kind)
                rows, held = [], 0
        if rows:
            yield pa.array(rows, kind)


def parsed(html: Column, url: Column | None = None, *fields: str) -> Column:
    """Struct of a page's parts (all, or the named fields); links are absolute where the page's
    address is given. The UDF is made when a session is there."""
    kind = StructType([f for f in StructType.fromDDL(PAGE) if not fields or f.name in fields])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return parsed_batches(batches, arrow)

    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER)(html, F.lit("") if url is None else url)


def absolute(base: Column, href: Column) -> Column:
    """A link as an absolute URL without query and fragment."""
    href = F.regexp_replace(F.trim(href), r"[?#].*$", "")
    root = F.concat(U.part(base, 1), F.lit("://"), U.part(base, 2))
    folder = F.regexp_replace(U.path(base), r"[^/]*$", "")
    return F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(U.part(base, 1), F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))


def page_emails(page: Column) -> Column:
    """Addresses of mailto links, structured data and the text, each once, in that order."""
    mail = F.transform(F.filter(page["links"], lambda x: x["href"].rlike("(?i)^mailto:")), lambda x: F.regexp_replace(F.coalesce(F.try_url_decode(x["href"]), x["href"]), r"(?i)^mailto:|\?.*$", ""))
    return F.array_distinct(F.transform(F.concat(mail, page["ld_emails"], E.emails_in(page["text"])), lambda e: F.lower(F.trim(e))))


def page_phones(page: Column) -> Column:
    """Numbers of structured data and the text, each once; a number doesn't run over a line's end."""
    return F.array_distinct(F.concat(F.filter(page["ld_phones"], E.is_phone), E.phones_in(F.array_join(page["parts"], " "))))


def _first_of(links: Column, kinds: dict[str, Callable[[Column], Column]]) -> Column:
    """map of each kind to the address of the first link that it takes."""
    first = lambda hit: F.try_element_at(F.filter(links, hit), F.lit(1))["url"]
    found = F.create_map(*[c for k, hit in kinds.items() for c in (F.lit(k), first(hit))])
    return F.map_filter(found, lambda _, v: v.isNotNull())


def _at(domain: str) -> Callable[[Column], Column]:
    return lambda link: link["host"].contains(domain)


def _with(words: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda link: _named(link, words)


def social_links(page: Column) -> Column:
    """First link to each network, by its domain; of a page parsed with its address."""
    return _first_of(page["links"], {d: _at(d) for d in V.SOCIAL_DOMAINS})


def _named(link: Column, words: tuple[str, ...]) -> Column:
    return _any(F.lower(link["text"]), words) | _any(F.lower(link["href"]), words)


def subpages(page: Column) -> Column:
    """First link of the same host for each kind of page, the page itself left out."""
    bare = lambda u: F.regexp_replace(u, "/+$", "")
    own = F.filter(page["links"], lambda x: (x["host"] == page["host"]) & (bare(x["url"]) != bare(page["base"])))
    return _first_of(own, {k: _with(words) for k, words in V.SUBPAGE_WORDS.items()})


def footer_links(page: Column) -> Column:
    """Links of the same host in a footer (an element of that name, class or id) that say they lead to a contact."""
    hit = lambda x: x["footer"] & (x["host"] == page["host"]) & _named(x, V.FOOTER_WORDS)
    return F.array_distinct(F.transform(F.filter(page["links"], hit), lambda x: x["url"]))


def homepage_score(page: Column) -> Column:
    """Business signals of a homepage, 100 at most."""
    hit = lambda k: F.exists(page["links"], lambda x: F.lower(x["href"]).contains(k) | F.lower(x["text"]).contains(k))
    body = F.lower(F.array_join(page["parts"], ""))
    points = [(hit(k), p) for k, p in SIGNALS.items()]
    points += [(F.exists(page["links"], lambda x: F.lower(x["href"]).contains("linkedin.com/company/")), 20), (body.rlike("copyright|©"), 10), (body.rlike("(?U)" + V.HOMEPAGE_EMAIL), 20), (body.rlike("(?U)" + V.HOMEPAGE_PHONE), 15)]
    return F.least(F.lit(100), sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0)))


def homepage_class(score: Column) -> Column:
    return F.when(score >= 80, F.lit("ALLOW")).when(score >= 50, F.lit("LIKELY_COMPANY")).otherwise(F.lit("REJECT"))


def homepage_verdict(html: Column, page: Column, keyword: Column | None = None) -> Column:
    """Class of a homepage; in exact mode (a keyword is given) only of one that holds the keyword literally."""
    out, title = homepage_class(homepage_score(page)), page["title"]
    if keyword is not None:
        said = F.array(title, title, F.array_join(page["parts"], ""), title)
        out = F.when(N.is_literal_match(said, keyword), out).otherwise(F.lit("REJECT"))
    return F.when(F.coalesce(html, F.lit("")) == "", F.lit("REJECT")).otherwise(out)


def is_real_html(html: Column, content_type: Column | None = None) -> Column:
    """A page, not a challenge: by content type (where one is given) and the first 4096 characters."""
    head, out = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 4096)), F.lit(True)
    for c in V.CHALLENGES:
        out = out & ~head.contains(c)
    if content_type is not None:
        kind = F.lower(F.coalesce(content_type, F.lit("")))
        out = out & (kind.contains(V.HTML_TYPES[0]) | kind.contains(V.HTML_TYPES[1]))
    return out


def layout_fingerprint(page: Column) -> Column:
    """MD5 of title, the first 20 classes and the number of elements."""
    title = F.when(page["title"] == "", F.lit("No Title Tag")).otherwise(page["title"])
    return F.md5(F.concat(F.lit("title:"), title, F.lit("||classes:"), F.array_join(page["classes"], ","), F.lit("||elements:"), page["elements"].cast("string")))


def _any(text: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def _is_profile(url: Column) -> Column:
    """A company's profile page on a known platform, or by its path anywhere but on listed hosts."""
    h, p = U.netloc(url), F.lower(U.path(url))
    out = _any(p, V.PROFILE_SIGNS) & ~_any(F.regexp_replace(h, "^[w.]+", ""), V.NO_PROFILE_HOSTS)
    for domain, prefix in V.PROFILE_PATHS:
        out = out | (h.contains(domain) & p.startswith(prefix) & (F.length(p) > len(prefix)))
    return out


def directory_links(page: Column, base: Column, most: int = V.DIRECTORY_LINKS) -> Column:
    """Profile pages that a listing links to: absolute, each once, in order, at most so many."""
    links = F.transform(F.filter(page["links"], lambda x: ~F.trim(x["href"]).rlike("^(?:#|javascript:|$)")), lambda x: F.regexp_replace(absolute(base, x["href"]), "/+$", ""))
    good = lambda u: u.startswith("http") & U.is_valid_result(u) & ~_any(F.regexp_replace(U.netloc(u), "^[w.]+", ""), V.NO_PROFILE_HOSTS) & _is_profile(u)
    return F.slice(F.array_distinct(F.filter(links, good)), 1, most)


def directory_links_in_text(text: Column, most: int = V.DIRECTORY_LINKS) -> Column:
    """Profile addresses written out in a text, each once, in order, at most so many."""
    found = F.regexp_extract_all(text, F.lit("https?://[^\\s\"'<>]+(?:/company/|/profile/|/organization/|/c/)[^\\s\"'<>]+"), F.lit(0))
    found = F.transform(found, lambda u: F.regexp_replace(u, "[.,;)\"']+$", ""))
    return F.slice(F.array_distinct(F.filter(found, lambda u: ~_any(F.regexp_replace(U.netloc(u), "^[w.]+", ""), V.NO_PROFILE_HOSTS))), 1, most)


def company_website(page: Column, url: Column) -> Column:
    """struct(website, source): a company's own site. Outside platforms the page itself; on them
    a redirect, the text, a link that says so, or the first link to somewhere else."""
    h, none = U.netloc(F.coalesce(url, F.lit(""))), F.lit("")
    is_ = lambda w, s: F.struct(w.alias("website"), s.alias("source"))
    out_of = lambda u: u.startswith("http") & ~_any(F.lower(u), U.PLATFORMS)
    first = lambda keep: F.try_element_at(F.filter(F.transform(page["links"], lambda x: F.struct(F.trim(x["href"]).alias("h"), F.lower(F.trim(x["text"])).alias("t"))), keep), F.lit(1))["h"]
    redirect = F.regexp_extract(first(lambda x: x["h"].contains("linkedin.com/redir/redirect") & x["h"].rlike("[?&]url=[^&#]")), "[?&]url=([^&#]+)", 1)
    redirect = F.nullif(F.coalesce(F.try_url_decode(redirect), redirect), F.lit(""))
    told = F.nullif(F.regexp_replace(F.regexp_extract(page["text"], r"\bWebsite\s+(https?://[^\s]+)", 1), r"/+\)?$|\)$", ""), F.lit(""))
    button = first(lambda x: x["t"].isin(*V.WEBSITE_LINKS) & out_of(x["h"]))
    other = first(lambda x: out_of(x["h"]) & ~_any(F.lower(x["h"]), V.NO_WEBSITE_HOSTS))
    by_host = F.when(h.contains("clutch.co"), F.lit("clutch")).when(h.contains("goodfirms.co"), F.lit("goodfirms")).otherwise(F.lit("schema"))
    own = h.contains("linkedin.com") & F.coalesce(redirect, told).isNotNull()
    return (
        F.when(F.coalesce(url, none) == "", is_(none, none)).when(~U.is_platform(url), is_(url, F.lit("homepage"))).when(own, is_(F.coalesce(redirect, told), F.lit("linkedin")))
        .when(button.isNotNull(), is_(button, by_host)).when(other.isNotNull(), is_(other, F.lit("inferred"))).otherwise(is_(none, none))
    )


def _roles(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, V.ROLES)), lambda r: F.rlike(text, F.concat(F.lit(r"\b"), r, F.lit(r"\b"))))


def snippet_profile(title: Column, snippet: Column, url: Column) -> Column:
    """Company profile from a search result alone: confidence 0.4."""
    text = F.lower(F.concat(title, F.lit(" "), snippet))
    own = ~U.is_platform(F.coalesce(url, F.lit("")))
    none = F.array().cast("array<string>")
    return F.struct(
        snippet.alias("description"), F.lit("search_snippet").alias("description_source"), F.transform(_roles(text), F.initcap).alias("positions"), none.alias("technologies"), none.alias("certifications"), none.alias("partners"),
        F.when(own, url).otherwise(F.lit("")).alias("website"), F.when(own, F.lit("homepage")).otherwise(F.lit("")).alias("website_source"), C.organisation(text, url).alias("company_type"), F.lit(0.4).alias("confidence"),
    )


def meta(page: Column, name: str) -> Column:
    """Content of the first meta tag of a name or property; empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(page["metas"], lambda m: m["name"] == name), F.lit(1))["content"], F.lit(""))


def page_profile(page: Column, url: Column, concepts: Column) -> Column:
    """Company profile from a homepage; concepts: terms that count as technologies."""
    said = lambda *terms: F.array_join(F.transform(F.filter(page["links"], lambda x: _any(F.lower(x["href"]), terms) | _any(F.lower(x["text"]), terms)), lambda x: F.concat(F.lit(" "), x["text"], F.lit(" ("), x["href"], F.lit(")"))), "")
    about = F.array_join(F.transform(F.filter(page["links"], lambda x: _any(F.lower(x["href"]), ("about", "who-we-are")) | F.lower(x["text"]).contains("about")), lambda x: F.concat(F.lit(" "), x["text"], F.lit(" ("), x["href"], F.lit(")"))), "")
    services, careers = said("services", "solutions", "what-we-do", "work"), said("careers", "jobs", "join-us", "vacancy")
    home = F.substring(page["body"], 1, 8000)
    full = F.lower(F.concat_ws(" ", home, about, services, careers))
    site = company_website(page, url)
    own = F.trim(meta(page, "description"))
    text = F.trim(F.when(own != "", own).otherwise(F.trim(meta(page, "og:description"))))
    extra = F.concat(F.when(F.trim(meta(page, "keywords")) != "", F.concat(F.lit(" Keywords: "), F.trim(meta(page, "keywords")), F.lit("."))).otherwise(F.lit("")), F.when(page["ld_text"] != "", F.concat(F.lit(" JSON-LD:  "), page["ld_text"], F.lit("."))).otherwise(F.lit("")))
    description = F.trim(F.concat(text, extra))
    found = F.filter(concepts, lambda c: F.rlike(full, F.concat(F.lit(r"\b\Q"), F.lower(c), F.lit(r"\E\b"))))
    roles, words = _roles(full), F.size(F.filter(F.split(home, " "), lambda w: w != ""))
    points = [(page["ld"], 0.1), (page["schema"], 0.1), (F.exists(page["metas"], lambda m: m["name"].startswith("og:")), 0.1), (F.size(page["headings"]) > 0, 0.05), (page["footer"], 0.05), (site["website"].contains("."), 0.1),
              (description != "", 0.1), (F.size(found) > 0, 0.1), (F.size(roles) > 0, 0.1), ((services != "") | (about != ""), 0.1)]
    score = F.lit(0.4) + F.when(words > 300, 0.2).when(words > 100, 0.1).when(words < 30, -0.1).otherwise(0.0) + sum((F.when(c, p).otherwise(0.0) for c, p in points), F.lit(0.0))
    held = lambda terms: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(full, t))
    return F.struct(
        description.alias("description"), F.when(own != "", F.lit("meta_description")).when(meta(page, "og:description") != "", F.lit("og_description")).otherwise(F.lit("meta_description")).alias("description_source"),
        F.transform(roles, F.initcap).alias("positions"), F.transform(found, N.concept).alias("technologies"), F.transform(held(V.CERTIFICATIONS), F.upper).alias("certifications"), F.transform(held(V.PARTNERS), F.initcap).alias("partners"),
        site["website"].alias("website"), site["source"].alias("website_source"), C.organisation(full, url).alias("company_type"), F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.1), score)), 2).alias("confidence"),
    )


def search_results(page: Column, most: int = 10) -> Column:
    """struct(parser, results) of a recorded result page. Strategies in order: links around a
    third-level heading, item lists of structured data, any outside link; the first that leaves
    a result that is not rejected counts. Ranks are places among what the strategy found."""
    kind = "array<struct<url:string,title:string,snippet:string>>"

    def target(href: Column) -> Column:
        q = F.regexp_extract(href, r"^/url\?(?:.*&)?q=([^&#]+)", 1)
        return F.when(q != "", F.coalesce(F.try_url_decode(q), q)).when(href.rlike("(?i)^https?://"), href)

    def row(u: Column, t: Column, s: Column) -> Column:
        return F.struct(u.alias("url"), t.alias("title"), s.alias("snippet"))

    null = F.lit(None).cast("string")
    links = F.filter(F.transform(page["links"], lambda x: F.struct(target(F.trim(x["href"])).alias("u"), x["text"].alias("t"), x["heading"].alias("h"), x["around"].alias("a"))), lambda x: x["u"].isNotNull() & ~C.is_skipped_host(x["u"]))

    def near(x: Column) -> Column:
        """Text around a link without its heading."""
        at = F.position(x["h"], x["a"])
        rest = F.when(at > 0, F.concat(F.substring(x["a"], F.lit(1), at - 1), F.substring(x["a"], at + F.length(x["h"]), F.length(x["a"])))).otherwise(x["a"])
        return F.nullif(F.substring(F.trim(rest), 1, 400), F.lit(""))

    ways = {
        "SemanticParser": F.transform(F.filter(links, lambda x: x["h"] != ""), lambda x: row(x["u"], x["h"], near(x))),
        "JsonLdParser": F.transform(page["ld_items"], lambda x: row(x["url"], x["title"], null)),
        "AnchorParser": F.transform(F.filter(links, lambda x: F.length(x["t"]) >= 5), lambda x: row(x["u"], x["t"], null)),
    }
    out = F.struct(F.lit("none").alias("parser"), F.array().cast("array<struct<url:string,title:string,snippet:string,rank:int,quality:string>>").alias("results"))
    for name, found in reversed(ways.items()):
        ranked = F.transform(F.slice(found.cast(kind), 1, most), lambda x, i: F.struct(x["url"].alias("url"), x["title"].alias("title"), x["snippet"].alias("snippet"), (i + 1).alias("rank"), C.result_quality(x["url"], x["title"], x["snippet"]).alias("quality")))
        good = F.filter(ranked, lambda x: x["quality"] != "Rejected")
        out = F.when(F.size(good) > 0, F.struct(F.lit(name).alias("parser"), good.alias("results"))).otherwise(out)
    return out


def people(page: Column) -> Column:
    """Blocks that hold a title, with the block before as the name: array<struct<name, designation>>,
    the designation being the first listed title; only where the name can be a person's."""
    titles = F.array(*[F.struct(F.lit(t).alias("word"), F.lit(t.upper() if t in V.DESIGNATION_ACRONYMS else t.title()).alias("label")) for t in V.DESIGNATIONS])

    def pair(b: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(page["blocks"], i - 1))
        name = F.when(F.size(F.filter(F.split(before, r"\s+"), lambda w: w != "")).between(1, V.NAME_WORDS), before)
        low = F.lower(b)
        title = F.when((b != "") & (F.length(b) <= V.TITLE_LENGTH), F.get(F.filter(titles, lambda t: F.contains(low, t["word"])), F.lit(0))["label"])
        return F.struct(name.alias("name"), title.alias("designation"))

    pairs = F.filter(F.transform(page["blocks"], pair), lambda p: p["designation"].isNotNull())
    return F.filter(pairs, lambda p: E.is_person_record(p["name"], p["designation"]))
