"""Queries of the record stages, helpers and merges over made records, with SQL of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadweave.functions import classify as C
from leadweave.functions import contact as E
from leadweave.functions import html as H
from leadweave.functions import matching as M
from leadweave.functions import names as N
from leadweave.functions import url as U
from leadweave.operators import dedup, lookup, merge, ranking, stages
from leadweave.operators import telemetry as T
from leadweave.plans.rules import _cases, _table, _values
from leadweave.sources import arrays, readers, sinks
from leadweave.sources.sinks import scratch
from leadweave.streaming import state

LINKS = (
    ("https://g.com/url?q=https%3A%2F%2Fa.com%2F&x=1", "Sales@Acme.com"), ("https://b.com/ck?u=a1aHR0cHM6Ly9hLmNvbS8", "https://www.Acme.co.uk/x"), ("https://www.Acme.com/a/b?c#d", "acme.com"), ("http://LinkedIn.com/company/A", "a@b@c.org"),
    ("https://clutch.co/profile/x", ""), ("https://x.acme.org:8080/", "http://x.y/z"),
)
TEXTS = (
    ("  Acme & Sons ", "company Company a b b", "mail a.b@c.de or x@y.zz", "Co-Founder & CEO", "LinkedIn"), ("Tata Consulting Services Pvt Ltd", "a  a", "no at", "Managing Director", " clutch"), ("What? now", "one", "@x.com y@z.io", "director of x", "blog"), ("a b c d e f g", "x X x", "", "intern", "?"),
    ("info@acme 12", "", "q@q.q q@q.qq", "", "wikipedia"), ("A1234567", "b B", "z@z.com.", "VP Sales", "Official Website"),
)
LISTS = (("A+b@example.com| C@D.com|c@d.com|bad", "(212) 555-0199|12|+91 98765-43210|x", "Ann|ann | Bob|BOB|", "a@acme.com|x@b.com"), ("x@a.com|y@b.com|z@c.com|q@d.com|r@e.com", "1234567", "x|X", "z@z.com"), ("", "", "", ""))


def link_helpers(spark, sf_dir):
    """Root, cache key, redirect target and address domain of made links."""
    d = _cases(_table(spark, sf_dir, "nation", "n_nationkey"), LINKS, url=0, address=1)
    u = F.col("url")
    return d.select("n_nationkey", "case", U.root_url(u).alias("root"), U.cache_key(u).alias("cache"), U.unwrapped_code(U.unwrapped(u)).alias("target"), U.address_domain(F.col("address")).alias("domain"), U.plain_domain_token(U.netloc(u)).alias("token"))


def text_helpers(spark, sf_dir):
    """Slugs, tidy texts, repeats, first addresses, registry candidates and scores of made texts."""
    d = _cases(_table(spark, sf_dir, "nation", "n_nationkey"), TEXTS, name=0, words=1, text=2, title=3, source=4)
    n = F.col("name")
    return d.select(
        "n_nationkey", "case", N.slug(n).alias("slug"), N.slug(n, "-").alias("dashed"), N.tidy(n).alias("tidy"), N.without_repeats(F.col("words")).alias("words"), E.is_garbage_name(n).alias("garbage"), E.first_email(F.col("text")).alias("email"),
        stages.is_registry_candidate(n).alias("registry"), C.decision_maker(F.col("title")).alias("decision"), C.source_score(F.col("source")).alias("source_score"), E.is_person_record(F.lit("Ann Example"), F.col("title")).alias("person"),
    )


def contact_lists(spark, sf_dir):
    """Merged addresses and numbers, items and people once, and own addresses of made lists."""
    d = _cases(_table(spark, sf_dir, "nation", "n_nationkey"), LISTS, x0=0, x1=1, x2=2, x3=3)
    of = lambda n: F.split(F.col(f"x{n}"), r"\|")
    people = F.transform(of(2), lambda x: F.struct(x.alias("name"), F.lit("CEO").alias("designation")))
    site = F.concat(F.lit("https://www."), F.when(F.col("case") == 0, F.lit("acme.com")).otherwise(F.lit("none.org")))
    return d.select(
        "n_nationkey", "case", F.array_join(E.merge_emails(of(0)), "|").alias("emails"), F.array_join(E.merge_phones(of(1)), "|").alias("phones"), F.array_join(dedup.distinct_items(of(2)), "|").alias("items"),
        F.array_join(F.transform(dedup.distinct_people(people), lambda p: p["name"]), "|").alias("people"), F.array_join(stages.own_emails(F.concat(of(0), of(3)), site), "|").alias("own"),
    )


def completeness_scores(spark, sf_dir):
    """Completeness and quality label of customers as leads."""
    k = F.col("c_custkey")
    has = lambda n: F.when(k % n == 0, F.lit("x")).otherwise(F.lit(""))
    arr = lambda n: F.when(k % n == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    s = C.completeness(has(2), has(3), has(5), has(7), has(11), arr(2), arr(3), (k % 101).cast("int"), F.element_at(F.array(F.lit("LinkedIn"), F.lit("blog"), F.lit("x")), (k % 3 + 1).cast("int")), (k % 130).cast("int"))
    return _table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", s.alias("score"), C.quality_label(s).alias("label"))


def verified_leads(spark, sf_dir):
    """Customers as leads against probe tables made of nations: the last row of a domain counts."""
    k = F.col("c_custkey")
    leads = _table(spark, sf_dir, "customer", k.alias("ord"), F.when(k % 10 == 0, F.lit("")).otherwise(F.col("c_name")).alias("company_name"), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("https://d"), (k % 25).cast("string"), F.lit(".com"))).alias("website"), F.array(F.concat(F.lit("a"), k.cast("string"), F.lit("@d"), (k % 25).cast("string"), F.lit(".com")), F.lit("b@none.org")).alias("emails"), F.array(F.when(k % 4 == 0, F.lit("+1 212 555 0199")).otherwise(F.lit("12-34"))).alias("phones"))
    n = _table(spark, sf_dir, "nation", "n_nationkey")
    domain = F.concat(F.lit("d"), F.col("n_nationkey").cast("string"), F.lit(".com"))
    mx = n.select(domain.alias("domain"), (F.col("n_nationkey") % 2 == 0).alias("has_mx"), F.lit("new").alias("reason"), F.lit(2).alias("ord")).unionByName(n.select(domain.alias("domain"), F.lit(True).alias("has_mx"), F.lit("old").alias("reason"), F.lit(1).alias("ord")))
    sites = n.select(F.concat(F.lit("https://"), domain).alias("url"), F.when(F.col("n_nationkey") % 5 == 0, 404).otherwise(200).alias("status"), F.lit("").alias("reason"))
    r = stages.verify(leads, mx, sites)
    both = r.kept.unionByName(r.rejects)
    return both.select("ord", F.array_join("verified_emails", " ").alias("emails"), F.size("verified_phones").alias("phones"), "website_reachable", "verification_passed")


def learned_terms(spark, sf_dir):
    """Event types learned for hours, and the terms that a dictionary takes up."""
    e = _table(spark, sf_dir, "events", F.hour("ts").cast("string").alias("keyword"), F.col("event_type").alias("term"), F.lit("services").alias("target_field"), (F.col("event_id") % 4 != 0).alias("accepted"), F.to_date("ts").cast("string").alias("day"))
    t = lookup.learned_terms(e)
    ontology = spark.createDataFrame([("0", "services", "view", 0), ("z", "concepts", "click", 1)], "domain string, channel string, term string, ordinal int")
    up = lookup.promoted(t, ontology).select(F.col("domain").alias("keyword"), "term", F.lit(True).alias("promoted"))
    return t.join(up, ["keyword", "term"], "left").select("keyword", "term", "seen", "accepted", "confidence", "first_seen", "last_seen", F.coalesce("promoted", F.lit(False)).alias("promoted"))


def derived_scores(spark, sf_dir):
    """Health score, quarantine and validity of each event's user at that event."""
    w = T.last_rows("user_id", ["ts", "event_id"], 20)
    good = (F.col("event_type") != "error").cast("double")
    ratio = F.avg(good).over(w)
    days = (F.col("event_id") % 40).cast("double")
    s = T.derived_score(ratio, ratio, T.freshness((F.col("event_id") % 5000).cast("double")), F.lit(0.5), days)
    return _table(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type").select("event_id", F.bround(s, 9).alias("score"), T.quarantine_seconds(F.col("event_id") % 7).alias("wait"), T.still_valid(F.col("ts").cast("timestamp"), F.lit("2024-01-16 00:00:00").cast("timestamp"), 86_400 * 3).alias("valid"))


def clean_totals(spark, sf_dir):
    """Totals of the clean stage over customers as leads, and how the flagged ones part."""
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    name = F.when(k % 10 == 0, F.lit("")).when(k % 17 == 0, F.lit("Top 10 widget makers")).otherwise(F.concat(F.lit("Company "), (k % 500).cast("string")))
    leads = _table(spark, sf_dir, "customer", k.alias("ord"), name.alias("company_name"), F.when(k % 2 == 0, F.lit("https://a.com")).alias("website"), F.when(k % 13 == 0, F.array(F.lit("x.png"))).otherwise(none).alias("emails"), none.alias("phones"), F.lit(None).cast("array<struct<name:string,designation:string>>").alias("people"))
    r = stages.clean(leads)
    keep, listing = stages.rescue(r.rejects)
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    named = count(dedup.by_company(leads.withColumnRenamed("company_name", "company"), "ord"), "named")
    return r.metrics.crossJoin(count(keep, "rescued")).crossJoin(count(listing, "listings")).crossJoin(named)  # single rows


def budgeted_tasks(spark, sf_dir):
    """The first 40 of the parts' queries, general ones before site searches, by weight; the second page of ten."""
    q = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("site:x.com "), "p_name")).otherwise(F.col("p_name"))
    p = _table(spark, sf_dir, "part", F.col("p_partkey").alias("ord"), q.alias("query"), (F.col("p_size") % 5).cast("double").alias("weight"))
    d = ranking.budgeted(p, "query", "weight", "ord", 40)
    return ranking.page(d, 2, 10, F.desc("weight"), F.col("ord")).select("ord", "query", "weight")


def json_results(spark, sf_dir):
    """Rows of made answers in several shapes, and columns as JSON text."""
    k, n = F.col("n_nationkey").cast("string"), F.col("n_name")
    q = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    body = F.when(F.col("n_nationkey") % 3 == 0, q('{"results": [{"url": "https://a.com/', k, '", "title": "', n, '", "snippet": "s"}, {"title": "no url"}, {"link": "https://b.com", "heading": "H"}]}')).when(F.col("n_nationkey") % 3 == 1, q('{"items": [{"link": "https://c.com/', k, '", "name": "', n, '", "description": "', F.repeat(F.lit("d"), F.lit(500)), '"}]}')).otherwise(F.lit("not json"))
    d = readers.search_results(_table(spark, sf_dir, "nation", "n_nationkey", body.alias("body")))
    return sinks.as_text_columns(d.withColumn("words", F.split("title", " "))).select("n_nationkey", "rank", "url", "title", F.length("snippet").alias("snippet"), "words")


def best_names(spark, sf_dir):
    """Customers of two files as companies: the best record of each canonical name."""
    k = F.col("c_custkey")
    a = _table(spark, sf_dir, "customer", k.alias("ord"), F.concat(F.lit("Acme "), (k % 40).cast("string"), F.when(k % 2 == 0, F.lit(" Pvt. Ltd.")).otherwise(F.lit(" India"))).alias("company"), (k % 7).cast("int").alias("relevance_score"), F.when(k % 3 == 0, F.lit("clutch")).otherwise(F.lit("blog")).alias("source"), F.when(k % 5 == 0, F.concat(F.lit("https://x.com/"), k.cast("string"))).alias("website"))
    b = a.select((F.col("ord") + 1_000_000).alias("ord"), "company", "relevance_score", "source", F.lit("l").alias("linkedin"))
    both = a.unionByName(b, allowMissingColumns=True)
    return merge.best_company(both).select("ord", "company", "relevance_score", "source", "website", "linkedin")


def page_people(spark, sf_dir):
    """People, structured contacts and footer links of a made page for each page."""
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<html><head><script type="application/ld+json">{"@graph": [{"email": "mailto:a'), k, F.lit('@x.com", "telephone": "+1 212 555 0199"}]}</script></head><body><p>Ann Example</p><p>Chief, CEO</p><div itemprop="email">b@x.com</div><footer><a href="/about">A</a><a href="https://y.com/z?q">Z</a></footer></body></html>'))
    base = F.lit("https://x.com/a/b")
    d = _table(spark, sf_dir, "pages", "page_id").select("page_id", H.parsed(html, base).alias("p"))
    return d.select("page_id", F.array_join(F.transform(H.people(F.col("p")), lambda x: F.concat_ws("/", x["name"], x["designation"])), "|").alias("people"), F.array_join("p.ld_emails", " ").alias("emails"), F.array_join("p.ld_phones", " ").alias("phones"), F.array_join(H.footer_links(F.col("p")), " ").alias("footer"))


def merged_history(spark, sf_dir):
    """Documents as lead records merged twice into one master: the second time only counts change."""
    k = F.col("doc_id")
    d = _table(spark, sf_dir, "documents", k.alias("ord"), F.concat(F.lit("Company "), k.cast("string")).alias("company_name"), F.concat(F.lit("https://"), F.lower("source"), F.lit(".com")).alias("website"), F.col("lang").alias("industry"), F.array(F.concat(F.lit("a"), (k % 3).cast("string"), F.lit("@x.com"))).alias("emails"), F.array().cast("array<string>").alias("phones"))
    first = stages.to_master(d).kept
    again = stages.to_master(d, first.drop("merged")).kept
    found = stages.lookup(again, industry="en").count()
    return again.select("domain", "company_name", "industry", F.array_join("emails", " ").alias("emails"), "merged", F.lit(found).cast("long").alias("english"))


def signal_counts(spark, sf_dir):
    """Running totals of each signal, as a stream's update would show them."""
    return state.counts(_table(spark, sf_dir, "events", "event_type", F.to_date("ts").alias("day")), ["event_type", "day"])


def search_reports(spark, sf_dir):
    """Event types as providers: the whole of a run."""
    e = _table(spark, sf_dir, "events", "event_type", "event_id", "value")
    r = T.search_report(e, "event_type", F.col("event_id") % 9, F.col("event_id") % 2, F.col("event_id") % 5, "value", slow=F.col("value") > 50, empty=F.col("event_id") % 9 == 0)
    return r.select("event_type", "searches", "results", "merged", "accepted", F.bround("yield", 9).alias("yield"), "slow", "empty", *[F.bround(c, 9).alias(c) for c in ("avg_ms", "median_ms", "p95_ms")])


def relevance_tiers(spark, sf_dir):
    """Search results made of part names against two concepts: scores, tiers, exact mode."""
    concepts, wanted = F.array(F.lit("widget"), F.lit("red")), F.array(F.lit("Gear Engineer"))
    title, snippet = F.col("p_name"), F.concat(F.lit("the "), F.lower("p_type"), F.lit(" "), F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, F.lit("s")).otherwise(F.lit("")))
    positions = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("engineer"))).otherwise(F.array().cast("array<string>"))
    d = _table(spark, sf_dir, "part", "p_partkey", M.snippet_score(title, snippet, positions, concepts, wanted).alias("score"), F.col("p_name").contains("widget").alias("literal"), "p_size")
    r, x, a = M.relevance(F.col("score"), F.col("literal")), M.relevance(F.col("score"), F.col("literal"), "exact"), C.accept(F.col("score"), (F.col("p_size") * 2).cast("int"), F.col("p_partkey") % 3 > 0)
    return d.select("p_partkey", "score", r["score"].alias("total"), r["tier"].alias("tier"), x["tier"].alias("exact"), a["classification"].alias("accepted"), a["score"].alias("accepted_score"))


def array_records(spark, sf_dir):
    """Customers written as JSON arrays, every eleventh record broken, and read by byte ranges:
    the records, and the broken ones by the number in their text."""
    folder = f"{scratch(spark)}/array_records-{uuid.uuid4().hex}"
    d = _table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    broken = F.concat(F.lit('{"c_custkey" '), F.col("c_custkey").cast("string"), F.lit("}"))
    arrays.write_arrays(d, folder, F.when(F.col("c_custkey") % 11 == 0, broken).otherwise(F.to_json(F.struct(*d.columns))))
    good, bad = arrays.json_array_records(spark, folder, "c_custkey long, c_name string, c_acctbal double")
    bad = bad.select(F.regexp_extract("raw", r"\d+", 0).cast("long").alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"), F.lit(True).alias("rejected"))
    return good.select("c_custkey", "c_name", "c_acctbal", F.lit(False).alias("rejected")).unionByName(bad)


QUERIES = {f.__name__: f for f in (
    array_records, link_helpers, text_helpers, contact_lists, completeness_scores, verified_leads, learned_terms, derived_scores, clean_totals, budgeted_tasks, json_results, best_names, page_people, merged_history, signal_counts, search_reports, relevance_tiers,
)}

_made = lambda rows, names: f"nation, (VALUES {_values(rows)}) v(\"case\", {names})"
_LINK_ROWS = (
    ("https://g.com", "g.com", "https://g.com/url?q=https%3A%2F%2Fa.com%2F&x=1", "acme.com", "g"), ("https://b.com", "b.com", "https://a.com/", "acme.co.uk", "b"), ("https://www.Acme.com", "acme.com", "https://www.Acme.com/a/b?c#d", "acme.com", "acme"), ("http://LinkedIn.com/company/A", "http://linkedin.com/company/a", "http://LinkedIn.com/company/A", "c.org", "linkedin"),
    ("https://clutch.co/profile/x", "https://clutch.co/profile/x", "https://clutch.co/profile/x", "", "clutch"), ("https://x.acme.org:8080", "x.acme.org:8080", "https://x.acme.org:8080/", "x.y", "acme"),
)
_TEXT_ROWS = (
    ("acmesons", "acme-sons", "Acme & Sons", "company a b", "0", "a.b@c.de", "1", "95", "95", "1"), ("tata", "tata-consulting-services-pvt-ltd", "Tata Consulting Services Pvt Ltd", "a", "0", "x", "1", "85", "90", "1"), ("whatnow", "what-now", "What? now", "one", "0", "y@z.io", "0", "70", "20", "1"),
    ("abcdefg", "a-b-c-d-e-f-g", "a b c d e f g", "x", "0", "x", "0", "20", "70", "1"), ("infoacme12", "info-acme-12", "info@acme 12", "", "1", "q@q.qq", "1", "0", "0", "0"), ("a1234567", "a1234567", "A1234567", "b", "1", "z@z.com", "1", "65", "100", "1"),
)
_LIST_ROWS = (("c@d.com|c@d.com", "2125550199|+919876543210", "Ann| Bob", "Ann| Bob|", "a@acme.com"), ("x@a.com|y@b.com|z@c.com|q@d.com|r@e.com", "1234567", "x", "x", ""), ("", "", "", "", "|"))
_GOOD = "avg(CAST(event_type <> 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_CUSTOMER = "CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'Top 10 widget makers' ELSE 'Company ' || c_custkey % 500 END"
ORACLES = {
    "array_records": "SELECT c_custkey, CASE WHEN c_custkey % 11 > 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 11 > 0 THEN c_acctbal END AS c_acctbal, c_custkey % 11 = 0 AS rejected FROM customer",
    "link_helpers": f"SELECT n_nationkey, \"case\", root, cache, target, domain, token FROM {_made(_LINK_ROWS, 'root, cache, target, domain, token')}",
    "text_helpers": f"SELECT n_nationkey, \"case\", slug, dashed, tidy, words, g = '1' AS garbage, CASE WHEN email <> 'x' THEN email END AS email, r = '1' AS registry, CAST(d AS INT) AS decision, CAST(s AS INT) AS source_score, p = '1' AS person FROM {_made(_TEXT_ROWS, 'slug, dashed, tidy, words, g, email, r, d, s, p')}",
    "contact_lists": f"SELECT n_nationkey, \"case\", emails, phones, items, people, own FROM {_made(_LIST_ROWS, 'emails, phones, items, people, own')}",
    "completeness_scores": """SELECT c_custkey, score, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS label FROM (SELECT c_custkey AS k, c_custkey, CAST(round_even(CAST(CASE WHEN c_custkey % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 5 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 5 ELSE 0 END + CASE WHEN c_custkey % 11 = 0 THEN 5 ELSE 0 END
        + (c_custkey % 101) / 100.0 * 15 + [95, 20, 70][c_custkey % 3 + 1] / 100.0 * 15 + greatest(0, 100 - c_custkey % 130) / 100.0 * 10 AS DOUBLE), 0) AS INT) AS score FROM customer)""",
    "verified_leads": """SELECT c_custkey AS ord, CASE WHEN c_custkey % 25 % 2 = 0 THEN 'a' || c_custkey || '@d' || c_custkey % 25 || '.com' ELSE '' END AS emails, CAST(c_custkey % 4 = 0 AS INT) AS phones, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 25 % 5 > 0 END AS website_reachable,
        c_custkey % 25 % 2 = 0 OR c_custkey % 4 = 0 OR c_custkey % 3 > 0 OR c_custkey % 10 > 0 AS verification_passed FROM customer""",
    "learned_terms": """SELECT keyword, term, seen, accepted, confidence, first_seen, last_seen, (keyword = '0' AND term = 'view') OR (confidence >= 0.75 AND accepted >= 3) AS promoted FROM (SELECT CAST(hour(ts) AS VARCHAR) AS keyword, event_type AS term, count(*) AS seen, count(*) FILTER (event_id % 4 <> 0) AS accepted, round_even(avg(CAST(event_id % 4 <> 0 AS INT)), 2) AS confidence,
        CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_seen, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_seen FROM events GROUP BY 1, 2)""",
    "derived_scores": f"""SELECT event_id, round_even(greatest(0.001, (0.75 * g + 0.15 * CASE WHEN a <= 120 THEN 1.0 WHEN a <= 600 THEN 0.8 WHEN a <= 1800 THEN 0.5 WHEN a <= 3600 THEN 0.2 ELSE 0.0 END + 0.05) * pow(0.995, event_id % 40)), 9) AS score, CAST([30, 60, 120, 300][least(event_id % 7 + 1, 4)] AS INT) AS wait,
        epoch(TIMESTAMP '2024-01-16 00:00:00') - floor(epoch(ts)) < 259200 AS valid FROM (SELECT *, event_id % 5000 AS a, {_GOOD} AS g FROM events)""",
    "clean_totals": f"""WITH d AS (SELECT c_custkey AS k, {_CUSTOMER} AS n, CASE WHEN c_custkey % 2 = 0 THEN 'https://a.com' ELSE '' END AS s FROM customer), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(n), s ORDER BY k) AS rn FROM d) WHERE rn = 1),
        g AS (SELECT *, n = '' OR starts_with(n, 'Top') AS l, k % 13 = 0 AS e FROM f)
        SELECT (SELECT count(*) FROM d) AS raw, count(*) AS rows, count(*) FILTER (NOT l AND NOT e) AS clean, count(*) FILTER (l OR e) AS flagged, (SELECT count(*) FROM d) - count(*) AS duplicates, count(*) FILTER (NOT l AND e) AS rescued, count(*) FILTER (l) AS listings, (SELECT count(DISTINCT n) FROM d WHERE n <> '') AS named FROM g""",
    "budgeted_tasks": "SELECT ord, query, weight FROM (SELECT p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN 'site:x.com ' || p_name ELSE p_name END AS query, CAST(p_size % 5 AS DOUBLE) AS weight FROM part ORDER BY p_partkey % 3 = 0, weight DESC, ord LIMIT 40) ORDER BY weight DESC, ord LIMIT 10 OFFSET 10",
    "json_results": """SELECT n_nationkey, 1 AS rank, CASE WHEN n_nationkey % 3 = 0 THEN 'https://a.com/' ELSE 'https://c.com/' END || n_nationkey AS url, n_name AS title, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 400 END AS snippet, '["' || replace(n_name, ' ', '","') || '"]' AS words FROM nation WHERE n_nationkey % 3 < 2
        UNION ALL SELECT n_nationkey, 3, 'https://b.com', 'H', NULL, '["H"]' FROM nation WHERE n_nationkey % 3 = 0""",
    "best_names": """WITH a AS (SELECT c_custkey AS ord, c_custkey % 40 AS n, 'Acme ' || c_custkey % 40 || CASE WHEN c_custkey % 2 = 0 THEN ' Pvt. Ltd.' ELSE ' India' END AS company, CAST(c_custkey % 7 AS INT) AS relevance_score, CASE WHEN c_custkey % 3 = 0 THEN 'clutch' ELSE 'blog' END AS source, CASE WHEN c_custkey % 5 = 0 THEN 'https://x.com/' || c_custkey END AS website, CAST(NULL AS VARCHAR) AS linkedin FROM customer),
        b AS (SELECT * FROM a UNION ALL SELECT ord + 1000000, n, company, relevance_score, source, NULL, 'l' FROM a)
        SELECT ord, company, relevance_score, source, coalesce(website, w) AS website, coalesce(linkedin, l) AS linkedin FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY relevance_score DESC, source = 'clutch' DESC, ord) AS rn, arg_min(website, ord) FILTER (website IS NOT NULL) OVER (PARTITION BY n) AS w, arg_min(linkedin, ord) FILTER (linkedin IS NOT NULL) OVER (PARTITION BY n) AS l FROM b) WHERE rn = 1""",
    "page_people": "SELECT page_id, 'Ann Example/CEO' AS people, 'a' || page_id || '@x.com b@x.com' AS emails, '+1 212 555 0199' AS phones, 'https://x.com/about' AS footer FROM pages",
    "merged_history": """SELECT lower(source) || '.com' AS domain, 'Company ' || min(doc_id) AS company_name, CASE WHEN length(arg_min(lang, doc_id)) <= 3 THEN upper(arg_min(lang, doc_id)) ELSE arg_min(lang, doc_id) END AS industry, array_to_string(list_sort(list_distinct(list('a' || doc_id % 3 || '@x.com'))), ' ') AS emails, count(*) + 1 AS merged,
        (SELECT count(*) FROM (SELECT arg_min(lang, doc_id) AS l FROM documents GROUP BY source) WHERE l = 'en') AS english FROM documents GROUP BY source""",
    "signal_counts": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1, 2",
    "search_reports": """SELECT event_type, count(*) AS searches, CAST(sum(event_id % 9) AS BIGINT) AS results, CAST(sum(event_id % 5) AS BIGINT) AS merged, CAST(sum(event_id % 2) AS BIGINT) AS accepted, round_even(CAST(sum(event_id % 2) AS DOUBLE) / count(*), 9) AS yield, count(*) FILTER (value > 50) AS slow, count(*) FILTER (event_id % 9 = 0) AS empty,
        round_even(avg(value), 9) AS avg_ms, round_even(quantile_cont(value, 0.5), 9) AS median_ms, round_even(quantile_cont(value, 0.95), 9) AS p95_ms FROM events GROUP BY 1""",
    "relevance_tiers": """WITH s AS (SELECT p_partkey, p_size, contains(p_name, 'widget') AS lit, CAST(trunc((CASE WHEN regexp_matches(p_name, '\\b(widget|red)\\b') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(p_name || CASE WHEN p_partkey % 4 = 0 THEN 's' ELSE '' END, '\\b(widget|red)\\b') THEN 30 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 0 END) / 60.0 * 100) AS INT) AS score FROM part),
        t AS (SELECT *, CASE WHEN lit THEN least(100, score + 40) ELSE score END AS total, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size * 2 AS INT) END AS deep FROM s)
        SELECT p_partkey, score, total, CASE WHEN total >= 80 THEN 'HIGH' WHEN total >= 60 THEN 'MEDIUM' WHEN total >= 40 THEN 'LOW' ELSE 'REJECT' END AS tier, CASE WHEN NOT lit THEN 'REJECT' WHEN total >= 80 THEN 'HIGH' WHEN total >= 60 THEN 'MEDIUM' WHEN total >= 40 THEN 'LOW' ELSE 'REJECT' END AS exact,
        CASE WHEN score >= 80 THEN 'ALLOW' WHEN score < 30 THEN 'REJECT' WHEN deep < 30 THEN 'REJECT' WHEN deep >= 80 THEN 'ALLOW' ELSE 'LIKELY_COMPANY' END AS accepted, CASE WHEN score >= 80 OR score < 30 THEN score ELSE coalesce(deep, score) END AS accepted_score FROM t""",
}
