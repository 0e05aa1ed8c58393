"""URL expressions: canonical forms, hosts and keys. All are pure Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave.functions import values as V

#: Query parameters that only track visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "referrer", "source", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_ga", "yclid", "dclid")
#: Query parameters that tell pages apart when crawling.
PAGE_PARAMETERS = ("lang", "page", "id")
#: Hosts where a path, not the host, stands for a company.
PLATFORMS = ("linkedin.com", "clutch.co", "goodfirms.co", "justdial.com", "crunchbase.com", "wellfound.com", "angel.co", "apollo.io", "zoominfo.com", "yellowpages.com", "yelp.com", "indiamart.com", "tradeindia.com", "sulekha.com", "chromewebstore.google.com", "play.google.com", "apps.apple.com", "workspace.google.com")
#: Second-level labels under which names are registered.
SECOND_LEVEL = ("co", "com", "org", "net", "edu", "gov", "ac")

#: scheme, authority, path, query (fragment left out) of any text; parts may be empty.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value evaluated once however often it is used."""
    return F.transform(F.array(value), then)[0]


def looked_up(table: dict[str, str], key: Column, otherwise: Column) -> Column:
    """A fixed table's entry for a key, else another value."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), otherwise)


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def _without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def _joined(scheme_: Column, host: Column, path_: Column, query_: Column) -> Column:
    head = F.when((scheme_ != "") & (host != ""), F.concat(scheme_, F.lit("://"), host)).when(scheme_ != "", F.concat(scheme_, F.lit(":"))).when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit(""))
    slash = F.when((host != "") & (path_ != "") & ~path_.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(head, slash, path_, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(F.lit("")))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.translate(text, "+", " "))


def canonical(url: Column) -> Column:
    """One key for URLs that mean the same: host without www., no tracking parameters,
    no empty ones, the others decoded and sorted, no fragment, no slash at the end."""
    url = F.trim(url)
    pairs = F.filter(F.split(query(url), "&"), lambda p: p.rlike("^[^=]+=.+$"))
    pairs = F.filter(pairs, lambda p: ~_decoded(F.substring_index(p, "=", 1)).isin(*TRACKING))
    pairs = F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]+=(.*)$", 1)).alias("v")))
    kept = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return _joined(scheme(url), _without_www(netloc(url)), F.regexp_replace(path(url), "/+$", ""), kept)


def crawl_canonical(url: Column) -> Column:
    """The crawler's key: all lower case, https, only page parameters in their order. Null: empty."""
    url = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    kind = F.when(scheme(url).isin("http", "https"), F.lit("https")).otherwise(scheme(url))
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: p.contains("=") & F.substring_index(p, "=", 1).isin(*PAGE_PARAMETERS)), "&")
    return F.when(url == "", F.lit("")).otherwise(_joined(kind, _without_www(part(url, 2)), F.regexp_replace(path(url), "/+$", ""), kept))


def lead_domain(website: Column) -> Column:
    """Merge key of a lead: its host, www. taken out wherever it stands, port kept."""
    website = F.trim(website)
    host = F.when(part(website, 2) == "", part(F.concat(F.lit("https://"), website), 2)).otherwise(part(website, 2))
    return F.lower(F.replace(host, F.lit("www."), F.lit("")))


def host(url: Column) -> Column:
    """Host without scheme and www.: what stands before the first slash."""
    return F.substring_index(F.regexp_replace(F.lower(F.trim(url)), r"^(?:https?://)?(?:www\.)?", ""), "/", 1)


def tld(host_: Column) -> Column:
    return F.element_at(F.split(host_, r"\."), -1)


def domain_token(host_: Column) -> Column:
    """The label that carries the name: below co.uk and the like one further left."""
    labels = F.filter(F.split(F.lower(host_), r"\."), lambda x: ~x.isin("", "www"))
    n = F.size(labels)
    compound = (n >= 3) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL) & (F.length(F.try_element_at(labels, F.lit(-1))) == 2)
    return F.when(n == 0, F.lit("")).when(n < 2, F.get(labels, F.lit(0))).when(compound, F.try_element_at(labels, F.lit(-3))).otherwise(F.try_element_at(labels, F.lit(-2)))


def plain_domain_token(host_: Column) -> Column:
    """The label before the last, whatever the suffix."""
    labels = F.split(_without_www(F.lower(host_)), r"\.")
    return F.when(F.size(labels) < 2, labels[0]).otherwise(F.try_element_at(labels, F.lit(-2)))


def base_domain(host_: Column) -> Column:
    """Registered domain: two labels, or three under a second-level label."""
    labels = F.split(_without_www(F.lower(host_)), r"\.")
    n = F.size(labels)
    three = (n >= 3) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    return F.array_join(F.slice(labels, F.greatest(n - F.when(three, 2).otherwise(1), F.lit(1)), F.lit(3)), ".")


def is_platform(url: Column) -> Column:
    return netloc(url).rlike("|".join(p.replace(".", r"\.") for p in PLATFORMS))


def root_url(url: Column) -> Column:
    """Scheme and host; platform URLs stay whole."""
    return F.when(is_platform(url), url).otherwise(F.concat(part(url, 1), F.lit("://"), part(url, 2)))


def cache_key(url: Column) -> Column:
    """Profile cache key: the host, or the whole URL on platforms."""
    return F.when(is_platform(url), F.lower(url)).otherwise(_without_www(netloc(url)))


def unwrapped(href: Column) -> Column:
    """Target of a result link of the page's own host (/url?q=), else the link; null if that is no http(s)."""
    h = F.trim(href)
    q = F.regexp_extract(h, r"^/url\?(?:[^#]*&)?q=([^&#]+)", 1)
    return F.when(q != "", _decoded(q)).when(h.rlike("(?i)^https?:"), h)


def unwrapped_code(href: Column) -> Column:
    """Target that a link's parameter u holds as URL-safe base64, after a mark a1 or without it;
    else the link; null if that is no http(s)."""

    def target(u: Column) -> Column:
        coded = F.translate(F.when(u.startswith("a1"), F.substring(u, 3, 1 << 30)).otherwise(u), "-_", "+/")
        padded = F.rpad(coded, (F.ceil(F.length(coded) / 4) * 4).cast("int"), F.lit("="))
        return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))

    u = F.regexp_extract(href, r"^[^?#]*\?(?:[^#]*&)?u=([^&#]+)", 1)
    return F.coalesce(F.when(u != "", bound(_decoded(u), target)), F.when(href.rlike("(?i)^https?:"), href))


def address_domain(text: Column) -> Column:
    """Domain of an e-mail address or a URL."""
    return F.when(text.contains("@"), F.lower(F.substring_index(text, "@", -1))).otherwise(_without_www(host(text)))


def is_valid_result(url: Column) -> Column:
    """Whether a search result can be followed: http(s), a dotted host, no blanks, no search page."""
    h = F.coalesce(netloc(url), F.lit(""))
    ok = scheme(url).isin("http", "https") & h.contains(".") & ~url.rlike(r"[\s!]") & ~path(url).rlike("^/search") & ~h.rlike(r"(^|\.)google\.")
    return F.coalesce(ok, F.lit(False))


def is_government(url: Column) -> Column:
    """Whether the host ends with a government suffix; or has a one-label suffix as a label."""
    h = netloc(url)
    ends = [h.endswith(x) for x in V.GOVERNMENT_SUFFIXES]
    own = F.array_contains(F.split(h, r"\."), "gov")
    out = own
    for e in ends:
        out = out | e
    return F.coalesce(out, F.lit(False))


def is_forum(url: Column) -> Column:
    """Whether a forum's domain stands anywhere in the URL."""
    u = F.lower(url)
    out = F.lit(False)
    for d in V.FORUM_DOMAINS:
        out = out | u.contains(d)
    return F.coalesce(out, F.lit(False))


def is_non_company(url: Column) -> Column:
    """Whether the host, its name or one of its labels is listed as no company; so is no host."""
    h = _without_www(netloc(F.coalesce(url, F.lit(""))))
    token = domain_token(h)
    labels = F.filter(F.split(h, r"\."), lambda x: ~x.isin(*V.SUFFIX_LABELS))
    listed = h.isin(*V.NON_COMPANY_DOMAINS) | token.isin(*V.NON_COMPANY_DOMAINS) | F.exists(labels, lambda x: x.isin(*V.NON_COMPANY_DOMAINS))
    return F.coalesce((h == "") | (token == "") | listed, F.lit(True))


def source_label(url: Column) -> Column:
    """Label of the source that a result's host stands for."""
    h, out = netloc(url), F.lit(V.SOURCE_LABEL)
    for k, label in reversed(V.SOURCE_LABELS.items()):
        out = F.when(h.contains(k), F.lit(label)).otherwise(out)
    return out


def spoken(token: Column) -> Column:
    """Words of a host label or a path's part, each with a capital first."""
    words = F.filter(F.split(token, "[-_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def override(token: Column, otherwise: Column) -> Column:
    """The name that a host label stands for, else another."""
    return looked_up(V.NAME_OVERRIDES, token, otherwise)


def profile_name(url: Column) -> Column:
    """Company name from the path of a profile page; empty for others."""
    h, p, out = netloc(url), F.lower(path(url)), F.lit("")
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    for domain, prefix in reversed(V.PROFILE_PATHS):
        inner = prefix.strip("/")
        name = F.get(parts, F.lit(len(inner.split("/"))))
        out = F.when(h.contains(domain) & p.contains(inner) & name.isNotNull(), spoken(name)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def company_from_host(url: Column) -> Column:
    """Company name from the host's label; empty on platforms."""
    token = domain_token(netloc(url))
    return F.when(is_platform(url) | (token == ""), F.lit("")).otherwise(override(token, spoken(token)))
