"""Queries over pages: canonical URLs, keep-first, page types, hosts, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.functions import classify as C
from leadweave.functions import html as H
from leadweave.functions import names as N
from leadweave.functions import url as U
from leadweave.operators import dedup, lookup, merge, ranking


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


TITLE = r"<title>([^<]*)"

# --- SQL pieces -----------------------------------------------------------------------
_P = r"'(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"


def _part(n: int, u: str = "url") -> str:
    return f"regexp_extract({u}, {_P}, {n})"


_TRACK = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'referrer', 'source', 'fbclid', 'gclid', 'msclkid', 'mc_cid', 'mc_eid', '_ga', 'yclid', 'dclid'"
CANON_SQL = f"""(lower({_part(1)}) || '://' || regexp_replace(lower({_part(2)}), '^www\\.', '') || regexp_replace({_part(3)}, '/+$', '') ||
  CASE WHEN len(list_filter(string_split({_part(4)}, '&'), lambda x: regexp_matches(x, '^[^=]+=.+$') AND split_part(x, '=', 1) NOT IN ({_TRACK}))) > 0
  THEN '?' || array_to_string(list_sort(list_filter(string_split({_part(4)}, '&'), lambda x: regexp_matches(x, '^[^=]+=.+$') AND split_part(x, '=', 1) NOT IN ({_TRACK}))), '&') ELSE '' END)"""
_LOW = "lower(trim(url))"
CRAWL_SQL = f"""('https://' || regexp_replace({_part(2, _LOW)}, '^www\\.', '') || regexp_replace({_part(3, _LOW)}, '/+$', '') ||
  CASE WHEN len(list_filter(string_split({_part(4, _LOW)}, '&'), lambda x: split_part(x, '=', 1) IN ('lang', 'page', 'id'))) > 0
  THEN '?' || array_to_string(list_filter(string_split({_part(4, _LOW)}, '&'), lambda x: split_part(x, '=', 1) IN ('lang', 'page', 'id')), '&') ELSE '' END)"""
HOST_SQL = f"regexp_replace(lower({_part(2)}), '^www\\.', '')"


# The lists of the SQL are written out here once more, so that a slip in the library's shows.
_NO_COMPANY = "'" + "','".join("""collegedunia careers360 shiksha getmyuni collegesearch engineering360 entrancezone collegevidya wikipedia britannica investopedia encyclopedia merriam-webster
    python.org pypi.org programiz w3.org geeksforgeeks tutorialspoint w3schools javatpoint coursera udemy edx khanacademy skillshare freecodecamp codecademy simplilearn pluralsight udacity nptel
    google play apple microsoft whatsapp x quora reddit stackoverflow stackexchange zhihu medium substack hashnode dev youtube youtu techcrunch theverge wired forbes businessinsider
    economictimes hindustantimes timesofindia businessstandard thehindu livemint glassdoor indeed naukri shine ambitionbox linkedin npmjs pypi github g2 capterra trustpilot getapp sulekha
    indiamart tradeindia""".split()) + "'"
_INFO = r"admission|college|universit|fees|fee structure|placement|syllabus|scholarship|exam|entrance|cutoff|tutorial|course|learn|documentation|docs|guide|introduction|beginner|cheatsheet|how to|step by step|wikipedia|definition|what is|meaning|overview|history|encyclopedia|explained|types of|blog|news|article|magazine|podcast|forum|community|discussion|question|answer|faq|thread|ranking|top 10|top 5|top 7|top 15|top 20|comparison|best |vs |versus|review|jobs|job openings|careers|hiring|vacanc|internship"
_PLATFORM = r"linkedin\.com|clutch\.co|goodfirms\.co|justdial\.com|crunchbase\.com|wellfound\.com|angel\.co|apollo\.io|zoominfo\.com|yellowpages\.com|yelp\.com|indiamart\.com|tradeindia\.com|sulekha\.com|chromewebstore\.google\.com|play\.google\.com|apps\.apple\.com|workspace\.google\.com"
_JOB = r"regexp_matches(p, '/job/|/jobs/|/careers/|/join-us|/careers-at/')"
_LEARN = rf"(regexp_matches(p, 'what-is-|what_is_|tutorial|course|learn|guide|blog|news|article|definition|ranking|admission|fees|placement|college|university') OR regexp_matches(t, '{_INFO}'))"
LISTED_SQL = f"(hn = '' OR tok = '' OR hn IN ({_NO_COMPANY}) OR tok IN ({_NO_COMPANY}) OR len(list_filter(string_split(hn, '.'), lambda x: x NOT IN ('com', 'org', 'net', 'edu', 'gov', 'co', 'in', 'io', 'tech', 'ai', 'app', 'info', 'biz') AND x IN ({_NO_COMPANY}))) > 0)"
PLATFORM_SQL = f"regexp_matches(h, '{_PLATFORM}')"
PAGE_TYPE_SQL = rf"""CASE
  WHEN regexp_matches(h, 'linkedin\.com|facebook\.com|twitter\.com|x\.com|instagram\.com|youtube\.com|reddit\.com|pinterest\.com') THEN CASE WHEN contains(u, 'linkedin.com/company') THEN 'COMPANY_PROFILE' ELSE 'SOCIAL' END
  WHEN regexp_matches(u, 'clutch\.co/profile/|goodfirms\.co/company/|crunchbase\.com/organization/|wellfound\.com/company/|zoominfo\.com/c/|apollo\.io/companies/') THEN 'COMPANY_PROFILE'
  WHEN contains(u, 'github.com/') AND (regexp_matches(p, '^/+orgs/+[^/]+/*$') OR (regexp_matches(p, '^/+[^/]+/*$') AND trim(p, '/') NOT IN ('features', 'marketplace', 'pricing', 'trending', 'explore', 'topics', 'collections', 'login', 'join', 'search', 'about'))) THEN 'COMPANY_PROFILE'
  WHEN regexp_matches(h, 'clutch\.co|goodfirms\.co') AND regexp_matches(p, '/search|/companies|/directory') THEN 'DIRECTORY_LIST'
  WHEN contains(h, 'crunchbase.com') AND contains(p, '/discover/') THEN 'DIRECTORY_LIST'
  WHEN trim(p, '/') <> '' AND regexp_matches('/' || trim(p, '/'), '/search|/directory|/directories|/category|/categories|/best|/top|/profiles') THEN 'DIRECTORY_LIST'
  WHEN regexp_matches(t, 'top companies|best companies|top software|best software|directories|directory list|list of best') THEN 'DIRECTORY_LIST'
  WHEN regexp_matches(h, 'play\.google\.com|apps\.apple\.com|chromewebstore\.google\.com|amazon\.com|ebay\.com') THEN 'MARKETPLACE'
  WHEN regexp_matches(h, 'indeed\.com|glassdoor\.com') THEN CASE WHEN contains(p, 'job') OR contains(u, 'viewjob') THEN 'JOB_POSTING' ELSE 'CAREERS' END
  WHEN {_JOB} THEN CASE WHEN regexp_matches(p, '[0-9]+$') OR regexp_matches(u, 'jobid|job_id') THEN 'JOB_POSTING' ELSE 'CAREERS' END
  WHEN contains(h, 'docs.') OR regexp_matches(p, '/docs/|/documentation/|/api-reference/') THEN 'DOCUMENTATION'
  WHEN regexp_matches(h, 'stackoverflow\.com|quora\.com|discourse|reddit\.com') OR contains(p, 'forum') THEN 'FORUM'
  WHEN contains(h, 'blog') OR regexp_matches(p, '/blog|/blogs/|/post/') THEN 'BLOG'
  WHEN contains(h, 'wikipedia.org') THEN 'ARTICLE'
  WHEN regexp_matches(h, 'techcrunch\.com|forbes\.com|nytimes\.com|bloomberg\.com|reuters\.com|medium\.com') THEN 'NEWS'
  WHEN {_LEARN} AND regexp_matches(u, 'news|press') THEN 'NEWS'
  WHEN {_LEARN} AND contains(u, 'blog') THEN 'BLOG'
  WHEN {_LEARN} THEN 'ARTICLE'
  WHEN NOT {PLATFORM_SQL} AND NOT {LISTED_SQL} AND p IN ('', '/', '/index.html', '/index.php', '/home') THEN 'COMPANY_HOMEPAGE'
  ELSE 'UNKNOWN' END"""
CLASS_SQL = f"""CASE WHEN k = 'UNKNOWN' THEN 'UNKNOWN' WHEN k IN ('COMPANY_HOMEPAGE', 'COMPANY_PROFILE') THEN 'ALLOW' WHEN k IN ('CAREERS', 'JOB_POSTING') AND NOT {PLATFORM_SQL} AND NOT {LISTED_SQL} THEN 'ALLOW'
        WHEN k = 'DIRECTORY_LIST' THEN 'DIRECTORY_LIST' ELSE 'REJECT' END"""


def typed_sql(rows: str) -> str:
    """Rows (url, title) with lower-case url u, host h, path p, title t, host without www. hn, its name tok."""
    labels = "list_filter(string_split(hn, '.'), lambda x: x NOT IN ('', 'www'))"
    return f"""(SELECT *, CASE WHEN len(l) = 0 THEN '' WHEN len(l) < 2 THEN l[1] WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ('co', 'com', 'org', 'net', 'edu', 'gov', 'ac') THEN l[-3] ELSE l[-2] END AS tok
      FROM (SELECT *, {labels} AS l FROM (SELECT *, regexp_replace(h, '^www\\.', '') AS hn FROM (SELECT *, lower(url) AS u, {_part(2, 'lower(url)')} AS h, {_part(3, 'lower(url)')} AS p, lower(title) AS t FROM {rows}))))"""


_TITLED = "(SELECT *, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM {0})"


def page_type_counts(spark, sf_dir):
    """Pages by type, the first page of each canonical URL only."""
    first = dedup.by_canonical_url(_pages(spark, sf_dir), "page_id")
    typed = first.select(C.page_type(F.col("url"), F.regexp_extract("html", TITLE, 1))["kind"].alias("page_type"))
    return typed.groupBy("page_type").agg(F.count(F.lit(1)).alias("n"))


def url_canonical(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.canonical(F.col("url")).alias("canonical"))


def crawl_canonical(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.crawl_canonical(F.col("url")).alias("canonical"))


def url_keep_first(spark, sf_dir):
    return dedup.by_canonical_url(_pages(spark, sf_dir), "page_id").select("page_id", U.canonical(F.col("url")).alias("canonical"))


def content_hash_dedup(spark, sf_dir):
    return dedup.by_content(_pages(spark, sf_dir), "page_id").select("page_id", F.sha2(N.stripped_html(F.col("html")), 256).alias("content_hash"))


def url_parts(spark, sf_dir):
    h = U.netloc(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"), U.tld(h).alias("tld"), U.plain_domain_token(h).alias("token"), U.base_domain(h).alias("base_domain"), U.lead_domain(F.col("url")).alias("lead_domain"), U.is_valid_result(F.col("url")).alias("valid"))


def result_classes(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.result_class(F.col("url"), F.regexp_extract("html", TITLE, 1)).alias("class"))


def domain_merge(spark, sf_dir):
    """Pages as lead records, merged by domain."""
    d = _pages(spark, sf_dir).select(U.lead_domain(F.col("url")).alias("domain"), F.col("page_id").alias("ord"), F.nullif(F.regexp_extract("html", TITLE, 1), F.lit("")).alias("company_name"), F.col("url").alias("website"), F.array(U.crawl_canonical(F.col("url"))).alias("emails"))
    return merge.merge_by_key(d).select("domain", "company_name", "website", F.array_join("emails", ",").alias("urls"), F.col("first_ord"), F.col("merged"))


def round_robin_hosts(spark, sf_dir):
    d = _pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"))
    return ranking.round_robin(d, F.col("host"), "page_id").select("page_id", "host", "turn")


def host_counts(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


def blocklist_hosts(spark, sf_dir):
    """Pages whose host is not among the hosts of page ids below 20 (a list from data)."""
    d = _pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"))
    return lookup.listed(d, F.col("host"), d.filter("page_id < 20"), "host", keep=False)


def request_fingerprints(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", dedup.fingerprint(F.lit("get"), F.col("url"), F.lit(""), F.lit("web")).alias("fingerprint"))


def html_links(spark, sf_dir):
    """Links of each page and how many stand in the footer."""
    p = _pages(spark, sf_dir).select("page_id", H.parsed(F.col("html"), None, "links").alias("p"))
    return p.select("page_id", F.size("p.links").cast("long").alias("links"), F.array_join(F.transform("p.links", lambda x: x["href"]), " ").alias("hrefs"))


#: Links of every kind that are judged, put into each page's menu beside its own.
MENU_LINKS = (
    '<a href="/contact-us?a=1#b">Write</a><a href="https://other.example.org/about">About</a><a href="/x">Our Company</a><a href="/who-we-are">W</a><a href="https://www.LinkedIn.com/company/acme">in</a><a href="https://m.facebook.com/a">f</a>'
    '<a href="https://x.com/acme?s=1">x</a><a href="https://x.com/later">x</a><a href="/data-protection">P</a><a href="mailto:a@jobs.example.com">j</a><a href="/a/jobs/">J</a><a href="https://youtube.com/c">y</a>'
)


def _with_menu_links(spark, sf_dir):
    """Each page as it is, and once more with further links in its menu."""
    p = _pages(spark, sf_dir).select("page_id", "url", "html")
    return p.withColumn("more", F.lit(False)).unionByName(p.select("page_id", "url", F.replace("html", F.lit("</nav>"), F.lit(MENU_LINKS + "</nav>")).alias("html"), F.lit(True).alias("more")))


def html_profile(spark, sf_dir):
    """Title, headings, contact fields, subpages, networks and homepage class of each page."""
    p = _with_menu_links(spark, sf_dir).select("page_id", "more", H.parsed(F.col("html"), F.col("url"), "title", "headings", "links", "text", "parts", "base", "host", "ld_emails", "ld_phones").alias("p"))
    s = H.homepage_score(F.col("p"))
    return p.select("page_id", "more", "p.title", F.size("p.headings").alias("headings"), F.array_join(H.page_emails(F.col("p")), ",").alias("emails"), F.array_join(H.page_phones(F.col("p")), ",").alias("phones"), F.to_json(H.subpages(F.col("p"))).alias("subpages"), F.to_json(H.social_links(F.col("p"))).alias("social"), s.alias("score"), H.homepage_class(s).alias("class"))


def exact_homepages(spark, sf_dir):
    """Class of each page as a homepage for its own language's name, literally or not."""
    p = _with_menu_links(spark, sf_dir).select("page_id", "more", "html", F.regexp_extract("url", "//([a-z]+)", 1).alias("word"), H.parsed(F.col("html"), F.col("url"), "title", "links", "parts").alias("p"))
    return p.select("page_id", "more", H.homepage_verdict(F.col("html"), F.col("p")).alias("class"), H.homepage_verdict(F.col("html"), F.col("p"), F.col("word")).alias("exact_class"))


def result_targets(spark, sf_dir):
    """Each page's address out of redirect links that hold it: as a parameter, and coded with and without a mark."""
    u = F.col("url")
    coded = F.regexp_replace(F.translate(F.base64(F.encode(u, "UTF-8")), "+/\r\n", "-_"), "=+$", "")
    link = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return _pages(spark, sf_dir).select(
        "page_id", U.unwrapped(link("/url?sa=t&q=", F.url_encode(u), "&x=1")).alias("asked"), U.unwrapped(link("https://e.example.com/url?q=", F.url_encode(u))).alias("elsewhere"),
        U.unwrapped_code(link("https://e.example.com/ck?p=1&u=a1", coded, "&n=2")).alias("marked"), U.unwrapped_code(link("/ck?u=", coded)).alias("plain"), U.unwrapped_code(u).alias("own"),
    )


QUERIES = {f.__name__: f for f in (page_type_counts, url_canonical, crawl_canonical, url_keep_first, content_hash_dedup, url_parts, result_classes, domain_merge, round_robin_hosts, host_counts, blocklist_hosts, request_fingerprints, html_links, html_profile, exact_homepages, result_targets)}
_FIRST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {CANON_SQL} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1)"
_STRIP = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_HOSTED = f"(SELECT page_id, {HOST_SQL} AS host FROM pages)"
ORACLES = {
    "page_type_counts": f"SELECT {PAGE_TYPE_SQL} AS page_type, count(*) AS n FROM {typed_sql(_TITLED.format(_FIRST))} GROUP BY 1",
    "url_canonical": f"SELECT page_id, {CANON_SQL} AS canonical FROM pages",
    "crawl_canonical": f"SELECT page_id, {CRAWL_SQL} AS canonical FROM pages",
    "url_keep_first": f"SELECT page_id, {CANON_SQL} AS canonical FROM {_FIRST}",
    "content_hash_dedup": f"SELECT page_id, h AS content_hash FROM (SELECT page_id, sha256({_STRIP}) AS h, row_number() OVER (PARTITION BY sha256({_STRIP}) ORDER BY page_id) AS rn FROM pages) WHERE rn = 1",
    "url_parts": f"""SELECT page_id, host, regexp_extract(n, '[^.]+$') AS tld, regexp_extract(host, '([^.]+)\\.[^.]+$', 1) AS token,
        CASE WHEN regexp_matches(host, '[^.]+\\.(co|com|org|net|edu|gov|ac)\\.[^.]+$') THEN regexp_extract(host, '[^.]+\\.[^.]+\\.[^.]+$') ELSE regexp_extract(host, '[^.]+\\.[^.]+$') END AS base_domain,
        replace(n, 'www.', '') AS lead_domain, s IN ('http', 'https') AND contains(n, '.') AND NOT regexp_matches(url, '[\\s!]') AND NOT starts_with(p, '/search') AND NOT regexp_matches(n, '(^|\\.)google\\.') AS valid
        FROM (SELECT page_id, url, {HOST_SQL} AS host, lower({_part(2)}) AS n, lower({_part(1)}) AS s, {_part(3)} AS p FROM pages)""",
    "result_classes": f"SELECT page_id, {CLASS_SQL} AS class FROM (SELECT *, {PAGE_TYPE_SQL} AS k FROM {typed_sql(_TITLED.format('pages'))})",
    "domain_merge": f"""SELECT domain, arg_min(title, page_id) FILTER (title IS NOT NULL) AS company_name, arg_min(url, page_id) AS website, array_to_string(list_sort(list_distinct(list(c))), ',') AS urls, min(page_id) AS first_ord, count(*) AS merged
        FROM (SELECT *, replace(lower({_part(2)}), 'www.', '') AS domain, nullif(regexp_extract(html, '<title>([^<]*)', 1), '') AS title, {CRAWL_SQL} AS c FROM pages) GROUP BY domain""",
    "round_robin_hosts": f"SELECT page_id, host, CAST(row_number() OVER (PARTITION BY host ORDER BY page_id) AS INT) AS turn FROM {_HOSTED}",
    "host_counts": f"SELECT host, count(*) AS pages FROM {_HOSTED} GROUP BY host",
    "blocklist_hosts": f"SELECT page_id, host FROM {_HOSTED} WHERE host NOT IN (SELECT host FROM {_HOSTED} WHERE page_id < 20)",
    "request_fingerprints": "SELECT page_id, sha1('GET:' || url || '::web') AS fingerprint FROM pages",
    "html_links": """SELECT page_id, CAST(len(h) AS BIGINT) AS links, array_to_string(h, ' ') AS hrefs FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>|<!--.*?-->', '', 'g'), '<a href="([^"]*)"', 1) AS h FROM pages)""",
}

#: Text of a page: scripts, styles and comments out, tags as blanks, entities as characters.
_CLEAN = r"""regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"""
_PLAIN = lambda x: f"trim(regexp_replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&'), '\\s+', ' ', 'g'))"
_ONCE = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_DIGITS = "length(regexp_replace(x, '[^0-9]', '', 'g'))"
_DATES = r"^\d{1,2}[.\-/]\d{1,2}[.\-/]\d{4}$|^\d{4}\s*[-–]\s*\d{4}$|^\d{4}\s*[-–]\s*\d{4}\s+\d{4}$|^\d{1,2}\.\d{2}\s*[-–]\s*\d{2}\.\d{2}$|^\d{4}$|^\d{8}$"
_SIGNAL = " + ".join(f"CASE WHEN contains(l, '{k}') THEN {n} ELSE 0 END" for k, n in (("contact", 20), ("about", 15), ("services", 15), ("products", 15), ("careers", 15), ("privacy", 10), ("linkedin.com/company/", 20)))
_ENTITIES = lambda x: f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&')"
_U = r"[\p{L}\p{N}\p{M}_.-]"
_SCORED = rf"""{_SIGNAL} + CASE WHEN regexp_matches(b, 'copyright|©') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(b, '{_U}+@{_U}+\.[\p{{L}}\p{{N}}\p{{M}}_]+') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(b, '\+?[0-9]{{1,3}}[-.\s]?\(?[0-9]{{2,3}}\)?[-.\s]?[0-9]{{3}}[-.\s]?[0-9]{{4}}') THEN 15 ELSE 0 END"""
_CLASSED = "CASE WHEN s >= 80 THEN 'ALLOW' WHEN s >= 50 THEN 'LIKELY_COMPANY' ELSE 'REJECT' END"
_MORE = f"(SELECT page_id, url, html, false AS more FROM pages UNION ALL SELECT page_id, url, replace(html, '</nav>', '{MENU_LINKS}</nav>'), true FROM pages)"
_READ = f"""(SELECT page_id, more, url, {_part(1)} || '://' || {_part(2)} AS root, lower({_part(2)}) AS h, {_PLAIN("regexp_extract(c, '(?s)<title>(.*?)</title>', 1)")} AS title, len(regexp_extract_all(c, '<h[12][^>]*>')) AS heads, {_PLAIN('c')} AS t,
    {_ENTITIES("regexp_replace(c, '(<[^>]*>)+', ' ', 'g')")} AS raw, lower({_ENTITIES("regexp_replace(c, '<[^>]*>', '', 'g')")}) AS b, lower(array_to_string(regexp_extract_all(c, '(?s)<a href="[^"]*".*?</a>'), ' ')) AS l,
    list_zip(regexp_extract_all(c, '<a href="([^"]*)"', 1), regexp_extract_all(c, '(?s)<a href="[^"]*"[^>]*>(.*?)</a>', 1)) AS pairs FROM (SELECT *, {_CLEAN} AS c FROM {_MORE}))"""
_LINKED = """list_transform(pairs, lambda x: {'said': lower(x[1] || ' ' || x[2]), 'u': CASE WHEN regexp_matches(x[1], '^[A-Za-z]+:') THEN x[1] ELSE root || x[1] END})"""
_HOST_OF = "lower(regexp_extract(x.u, '^[A-Za-z]+://([^/?#]*)', 1))"
_KINDS = (("contact_page", "contact|get-in-touch|reach-us"), ("about_page", "about|company|who-we-are"), ("team_page", "team|people|leadership|management|founders|executives|board|directors"), ("careers_page", "careers|jobs|join-us|work-with-us"), ("privacy_page", "privacy|data-protection"))
_JSON = lambda found: "'{' || array_to_string(list_filter([" + ", ".join(f"'\"{k}\":\"' || ({x})[1].u || '\"'" for k, x in found) + "], lambda x: x IS NOT NULL), ',') || '}'"
_SUBPAGES = _JSON([(k, f"list_filter(k, lambda x: {_HOST_OF} = h AND rtrim(x.u, '/') <> rtrim(url, '/') AND regexp_matches(x.said, '{w}'))") for k, w in _KINDS])
_SOCIAL = _JSON([(d, f"list_filter(k, lambda x: contains({_HOST_OF}, '{d}'))") for d in ("linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com")])
ORACLES["html_profile"] = f"""SELECT page_id, more, title, CAST(least(5, heads) AS INT) AS headings, array_to_string({_ONCE('e')}, ',') AS emails, array_to_string({_ONCE('p')}, ',') AS phones, {_SUBPAGES} AS subpages, {_SOCIAL} AS social, CAST(least(100, s) AS INT) AS score, {_CLASSED} AS class
    FROM (SELECT *, {_SCORED} AS s, {_LINKED} AS k,
        list_transform(list_concat(CASE WHEN more THEN ['a@jobs.example.com'] ELSE [] END, regexp_extract_all(t, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')), lambda x: lower(trim(x))) AS e,
        list_filter(regexp_extract_all(raw, '[+]?[0-9(][0-9\\s().-]{{5,20}}[0-9]'), lambda x: NOT regexp_matches(x, '[\\n\\r]') AND NOT regexp_matches(x, '{_DATES}') AND {_DIGITS} BETWEEN 7 AND 15 AND regexp_matches(x, '^[+\\d(][\\d\\s\\-().]{{5,20}}[\\d]$')) AS p FROM {_READ})"""
#: The word is of ASCII letters and of no listed root, so that the page's text in lower case is all that is asked.
ORACLES["exact_homepages"] = f"""SELECT page_id, more, {_CLASSED} AS class, CASE WHEN contains(regexp_replace(regexp_replace(b, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'), regexp_extract(url, '//([a-z]+)', 1)) THEN {_CLASSED} ELSE 'REJECT' END AS exact_class FROM (SELECT *, {_SCORED} AS s FROM {_READ})"""
ORACLES["result_targets"] = "SELECT page_id, url AS asked, 'https://e.example.com/url?q=' || url_encode(url) AS elsewhere, url AS marked, url AS plain, url AS own FROM pages"
