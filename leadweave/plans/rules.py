"""Queries over made inputs that try every rule: URLs, titles, keywords, answers, logs.

Each takes its rows from a whole table (ids and names) and pairs them with written-out cases, so
that classes which the supplied data doesn't hold occur. The SQL has its lists written out
anew: it shares none with the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.functions import classify as C
from leadweave.functions import contact as E
from leadweave.functions import html as H
from leadweave.functions import names as N
from leadweave.functions import url as U
from leadweave.operators import lookup, planner, ranking, stages
from leadweave.operators import telemetry as T
from leadweave.plans.pages import CLASS_SQL, CRAWL_SQL, LISTED_SQL, PAGE_TYPE_SQL, PLATFORM_SQL, _part, typed_sql
from leadweave.streaming import state

URLS = (
    ("https://www.linkedin.com/company/acme", "Acme"), ("https://facebook.com/acme", ""), ("https://clutch.co/profile/acme-tools", "Acme | Clutch"), ("https://goodfirms.co/company/acme_x", ""), ("https://www.crunchbase.com/organization/acme", ""),
    ("https://wellfound.com/company/acme", ""), ("https://www.zoominfo.com/c/acme-inc/12", ""), ("https://apollo.io/companies/Acme", ""), ("https://github.com/acme", ""), ("https://github.com/orgs/acme", ""), ("https://github.com/pricing", ""), ("https://github.com/a/b", ""),
    ("https://clutch.co/directory/x", ""), ("https://goodfirms.co/companies", ""), ("https://crunchbase.com/discover/x", ""), ("https://acme.com/categories/x", ""), ("https://acme.com/x", "List of best tools"), ("https://play.google.com/store", ""), ("https://www.amazon.com/dp/1", ""),
    ("https://indeed.com/viewjob?x=1", ""), ("https://glassdoor.com/Overview", ""), ("https://acme.com/jobs/12", ""), ("https://acme.com/careers/", ""), ("https://acme.com/careers/x?jobid=3", ""), ("https://docs.acme.com/x", ""), ("https://acme.com/docs/a", ""),
    ("https://stackoverflow.com/q/1", ""), ("https://acme.com/forums/1", ""), ("https://blog.acme.com/", ""), ("https://acme.com/post/x", ""), ("https://en.wikipedia.org/wiki/Acme", ""), ("https://www.forbes.com/x", ""), ("https://acme.com/press/what-is-x", ""), ("https://acme.com/a", "A Tutorial for Beginners"),
    ("https://acme.com/", "Acme - Home"), ("https://www.acme.co.in", "Acme Solutions | Acme"), ("https://acme.com/index.html", ""), ("https://acme.com/x/y", "Widgets : Acme"), ("https://medium.com/", ""), ("https://data.gov.in/", "Portal"), ("https://agency.govt.nz/", ""), ("https://dev.to/", ""), ("https://www.quora.com/x", ""),
    ("https://apple.com", ""), ("https://tcs.com/", "What is consulting?"), ("https://acme.museum/", "About Us"), ("ftp://acme.com/", "x"), ("nonsense", "The best of all"), ("", "Acme"), ("https://justdial.com/acme", "Best Acme Stores - Justdial"), ("https://angel.co/acme", "Acme Labs"),
)
KEYWORDS = ("data engineer", "python", "react native developer", "crm", "seo", "software companies", "bakery", "HR", "c++", "power bi", "site:clutch.co ai", 'site:x.com "ai" lab', "best firms for glass", "power bi dashboards for retail shops", "glass", "real estate", "fintech", "digital marketing", "companies", "boss")
ERRORS = ("Captcha seen", "redirected to /sorry/", "/enablejs", "cookie consent", "could not parse", "zero hits", "SSL cert expired", "self signed", "TLS handshake failed", "read timed out", "curl: (28)", "connection reset by peer", "curl: (97) socks", "HTTP 429", "Too Many Requests", "boom", "")
EMAILS = ("zed@a.com", "info@a.com", "noreply@a.com", "CEO@a.com", "sales.team@a.com", "mailer@a.com", "hello@a.com", "founders@a.com", "bd@a.com", "alerts@a.com", "partnership@a.com", "businessdev@a.com", "contact@a.com", "support@a.com")
NAMES = ("What is Acme", "Acme Guide", "Acme?", "The Acme", "Acme", "Versus Labs", "Acme Pvt Ltd", "home", "A", "About Us", "Is it", "overviews", "Acme | Tools - Home: x", " - Acme -", "a:b c", "IBM India Pvt. Ltd.", "Rockwell Automation Inc", "Ann Lee - CEO - Acme | In", "Bo, Jr", "machine learning v2.1", "robots v3", "internet of things", "")


def _table(spark, sf_dir, name, *cols) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _cases(df: DataFrame, cases, **names: int | None) -> DataFrame:
    """Each row beside each case (`case` numbers them); names: a column's place in a case (None: the case itself)."""
    rows = [c if isinstance(c, tuple) else (c,) for c in cases]
    table = F.array(*[F.struct(F.lit(i).alias("case"), *[F.lit(r[at or 0]).alias(n) for n, at in names.items()]) for i, r in enumerate(rows)])
    return df.withColumn("_c", F.explode(table)).select(*df.columns, "_c.*")


def _values(cases) -> str:
    """The cases as SQL rows (case, columns)."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join([str(i), *map(q, c if isinstance(c, tuple) else (c,))]) + ")" for i, c in enumerate(cases))


def page_types_made(spark, sf_dir):
    """Kinds and classes of made pages, one set for each nation."""
    d = _cases(_table(spark, sf_dir, "nation", "n_nationkey"), URLS, url=0, title=1)
    u, t = F.col("url"), F.col("title")
    return d.select("n_nationkey", "case", C.page_type(u, t)["kind"].alias("kind"), C.result_class(u, t).alias("class"), U.is_non_company(u).alias("listed"))


def url_judgements(spark, sf_dir):
    """Government, forum, source label, names from host and path, and own e-mail domains of made URLs."""
    d = _cases(_table(spark, sf_dir, "nation", "n_nationkey"), URLS, url=0, title=1)
    u = F.col("url")
    return d.select("n_nationkey", "case", U.is_government(u).alias("government"), U.is_forum(u).alias("forum"), U.source_label(u).alias("source"), U.profile_name(u).alias("profile"), U.company_from_host(u).alias("host_name"), U.domain_token(U.netloc(u)).alias("token"))


def company_rejections(spark, sf_dir):
    """First reasons against made companies and leads, named by page titles."""
    d = _cases(_table(spark, sf_dir, "nation", "n_nationkey"), URLS, url=0, title=1)
    n, u, e = F.col("title"), F.col("url"), F.lit("")
    return d.select("n_nationkey", "case", C.company_rejection(n, u, e, e).alias("company"), C.lead_rejection(n, u, F.lit("Google"), e, F.when(F.col("case") % 10 == 9, F.lit("Education Company"))).alias("lead"))


def guessed_companies(spark, sf_dir):
    """Company names guessed from made results."""
    d = _cases(_table(spark, sf_dir, "nation", "n_nationkey"), URLS, url=0, title=1)
    return d.select("n_nationkey", "case", N.guessed_company(F.col("title"), F.col("url")).alias("name"))


def name_rules(spark, sf_dir):
    """Phrases, placeholders, canonical names, parts, concepts and candidate domains of made names."""
    d = _cases(_table(spark, sf_dir, "nation", "n_nationkey"), NAMES, name=None)
    n = F.col("name")
    return d.select(
        "n_nationkey", "case", N.is_sentence(n).alias("sentence"), N.is_company_name(n).alias("company"), N.company_name(n).alias("canonical"), F.array_join(N.title_parts(n), "#").alias("parts"), N.profile_title_name(n).alias("person"),
        N.concept(n).alias("concept"), F.array_join(stages.domain_candidates(n), " ").alias("domains"), C.is_polish_article(n, F.lit("")).alias("article"),
    )


def keyword_classes(spark, sf_dir):
    """Intent, category, expectation and near-equal key of made keywords with each nation's name."""
    d = _cases(_table(spark, sf_dir, "nation", "n_nationkey", "n_name"), KEYWORDS, word=None)
    k = F.when(F.col("n_nationkey") % 2 == 0, F.col("word")).otherwise(F.concat_ws(" ", "word", F.lower("n_name")))
    return d.select("n_nationkey", "case", C.keyword_intent(k).alias("intent"), C.keyword_category(k).alias("category"), C.query_expectation(k).alias("expectation"), N.query_key(k).alias("key"))


def error_classes(spark, sf_dir):
    """Errors by class and outcome: each event has one of the made messages."""
    d = _table(spark, sf_dir, "events", "event_id").withColumn("m", F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("event_id") % len(ERRORS) + 1).cast("int")))
    kind = C.error_class(F.col("m"))
    return d.groupBy(kind.alias("kind"), C.error_outcome(kind).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def ranked_emails(spark, sf_dir):
    """Made addresses, a different part of them for each nation, ranked."""
    e = F.filter(F.array(*map(F.lit, EMAILS)), lambda x, i: (i + F.col("n_nationkey")) % 3 != 0)
    return _table(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", F.array_join(E.ranked_emails(e), " ").alias("emails"))


def text_industries(spark, sf_dir):
    """Industry, company type and kind of organisation of every document."""
    t = F.col("text")
    return _table(spark, sf_dir, "documents", "doc_id", "text", "source").select("doc_id", C.industry(t).alias("industry"), C.company_type(t).alias("company_type"), C.organisation(t, F.concat(F.lit("https://"), F.lower("source"), F.lit(".com/"))).alias("organisation"))


def real_html(spark, sf_dir):
    """Which pages, and which of them with a challenge or another type put before, are pages."""
    d = _table(spark, sf_dir, "pages", "page_id", "html")
    head = F.when(F.col("page_id") % 5 == 0, F.lit("<p>Just a Moment</p>")).when(F.col("page_id") % 5 == 1, F.concat(F.repeat(F.lit("x"), F.lit(4090)), F.lit("recaptcha"))).otherwise(F.lit(""))
    kind = F.when(F.col("page_id") % 7 == 0, F.lit("application/json")).otherwise(F.lit("Text/HTML; charset=utf-8"))
    return d.select("page_id", H.is_real_html(F.concat(head, "html"), kind).alias("real"))


def contact_queries(spark, sf_dir):
    """Queries for contacts of suppliers, by what is known of them."""
    k = F.col("s_suppkey")
    q = planner.contact_queries(F.col("s_name"), k % 2 == 0, k % 3 == 0, k % 5 == 0)
    return _table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select("s_suppkey", F.posexplode(q).alias("place", "query"))


def search_plan(spark, sf_dir):
    """Search tasks planned from part names, with and without a place."""
    place = F.when(F.col("p_partkey") % 2 == 0, F.lit(" Pune")).otherwise(F.lit(""))
    k = _table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.concat(F.lower("p_name"), place).alias("keyword")).distinct()
    return planner.plan(k, "hybrid", None)


def company_queries(spark, sf_dir):
    """Search queries for companies of each part name's industry, in two ways."""
    k = _table(spark, sf_dir, "part", "p_name").select(F.lower("p_name").alias("keyword"), F.lit("Pune").alias("location")).distinct()
    return planner.company_queries(k, "b2b", 60).withColumn("kind", F.lit("b2b")).unionByName(planner.company_queries(k, "b2c", 60).withColumn("kind", F.lit("b2c")))


def closest_domains(spark, sf_dir):
    """Domain of each word of part names in a dictionary made of nations by region."""
    o = _table(spark, sf_dir, "nation", F.col("n_regionkey").cast("string").alias("domain"), F.lower("n_name").alias("term"), F.col("n_nationkey").alias("ordinal"))
    words = _table(spark, sf_dir, "nation", F.explode(F.array(F.lower(F.substring("n_name", 1, 2)), F.lower("n_name"), F.lower(F.right("n_name", F.lit(3))))).alias("keyword")).distinct()
    return lookup.closest_domain(words, o)


def priority_queue(spark, sf_dir):
    """Orders as waiting requests: new priorities for two classes, then the place of each."""
    o = _table(spark, sf_dir, "orders", F.col("o_orderkey").alias("seq"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_custkey") % 3).alias("depth"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("provider"))
    q = ranking.priority_queue(o, spark.createDataFrame([("O", 9), ("X", 1)], "provider string, priority int"))
    return ranking.renumbered(q, F.desc("priority"), F.col("depth"), F.col("ts"), F.col("seq"), groups=["provider"]).select("seq", "provider", "priority", "rank")


def provider_scores(spark, sf_dir):
    """Users as providers: exploring scores and their order."""
    k = F.col("event_type")
    g = _table(spark, sf_dir, "events", "user_id", "event_type", "value").groupBy("user_id").agg(F.count(F.lit(1)).alias("q"), F.count_if(k == "purchase").alias("l"), F.count_if(k == "signup").alias("a"), F.count_if(k == "error").alias("f"), F.avg("value").alias("v"))
    score = T.exploring_score(F.col("q"), F.col("l"), F.col("a"), F.col("q") - F.col("f"), F.col("f"), F.col("v") / 10, F.col("user_id") % 3)
    p = g.select(F.col("user_id").alias("provider"), (F.col("user_id") % 7).cast("int").alias("position"), F.col("q").alias("queries"), F.when(F.col("user_id") % 5 == 0, F.col("q")).otherwise(F.lit(0)).alias("failures"), (F.col("user_id") % 2).alias("cost"), (F.col("user_id") % 11 != 0).alias("healthy"), F.lit("CLOSED").alias("breaker"))
    places = ranking.provider_order(p.withColumn("position", (F.col("position") * 1000 + F.col("provider")).cast("int")))
    return g.select("user_id", F.bround(score, 9).alias("score")).join(places.select(F.col("provider").alias("user_id"), "place"), "user_id")


def parser_report(spark, sf_dir):
    """Event types as parsers of each day's pages."""
    e = _table(spark, sf_dir, "events", F.concat_ws("-", "event_type", F.dayofmonth("ts").cast("string")).alias("parser"), "value", "user_id")
    r = T.parser_report(e, "parser", F.col("user_id") % 3 > 0, "value")
    return r.select("parser", "successes", "failures", F.bround("success_rate", 9).alias("success_rate"), F.bround("avg_time_ms", 9).alias("avg_time_ms"))


def parser_extremes(spark, sf_dir):
    e = _table(spark, sf_dir, "events", F.col("event_type").alias("parser"), "value", "user_id")
    r = T.best_and_worst_parser(T.parser_report(e, "parser", F.col("user_id") % 3 > 0, "value"), "parser")
    return r.select("best", "worst", F.bround("avg_parse_ms", 9).alias("avg_parse_ms"))


def source_ratings(spark, sf_dir):
    """Points for each run, and stars, of every user as a source."""
    kind = F.lit(None).cast("string")
    for k, v in {"purchase": "accepted_company", "signup": "contact_found", "view": "zero_result", "click": "search_hit", "error": "captcha"}.items():
        kind = F.when(F.col("event_type") == k, F.lit(v)).otherwise(kind)
    f = T.feedback(_table(spark, sf_dir, "events", "user_id", "event_id", kind.alias("outcome")), "user_id", "event_id")
    w = T.feedback_weight(F.col("failures") * 10, F.col("user_id") % 50, F.col("queries_run"), F.col("score"), F.col("failures") * 15, F.col("user_id") % 7)
    return T.source_ratings(f, "user_id").join(f.select("user_id", F.bround(w, 9).alias("weight")), "user_id").select("user_id", F.bround("score", 9).alias("score"), "stars", "queries_run", "weight")


def template_roi(spark, sf_dir):
    """Templates of made queries, one for each event: runs, leads and their share."""
    made = F.array(*[F.concat(F.lit(a), (F.col("user_id") % 9).cast("string"), F.lit(b)) for a, b in (("best crm", " Pune"), ("top crm", " Pune"), ('site:clutch.co "crm', '" Pune'), ('site:clutch.co "crm', '"'), ('site:github.com "crm', '" Pune'), ("crm", ""))])
    e = _table(spark, sf_dir, "events", F.element_at(made, (F.col("event_id") % 6 + 1).cast("int")).alias("query"), F.when(F.col("event_type") == "purchase", F.lit("accepted_company")).alias("outcome"))
    return T.template_report(e, planner.matching_template(F.col("query"))).select("template", "runs", "leads", F.bround("roi", 9).alias("roi"))


def score_folds(spark, sf_dir):
    """Each user's score after its outcomes in order."""
    kind = F.when(F.col("event_type") == "error", F.lit("captcha")).when(F.col("event_type") == "view", F.lit("timeout")).when(F.col("event_type") == "click", F.lit("zero_results")).otherwise(F.lit("valid_results"))
    return T.score_fold(_table(spark, sf_dir, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", kind)


def throttle_rates(spark, sf_dir):
    """Each user's request rate after its answers in order."""
    e = _table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value")
    r = T.throttle_fold(e, "user_id", "event_id", F.when(F.col("event_type") == "error", 429).otherwise(200), F.col("event_type") == "signup", F.col("value") / 10)
    return r.select("user_id", F.bround("rate", 9).alias("rate"))


def streak_breakers(spark, sf_dir):
    """Breakers that open for two days at two errors in a row."""
    e = _table(spark, sf_dir, "events", "user_id", "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return T.streak_breaker(e, "user_id", "event_id", F.col("t"), F.col("event_type") == "error", 2, 172_800.0, True)


def crawl_budgets(spark, sf_dir):
    """Pages that a crawl takes with four of each base domain's hosts."""
    return state.crawl_budget(_table(spark, sf_dir, "pages", "page_id", "url"), "page_id", 4).select("page_id", "domain")


def made_directory(spark, sf_dir):
    """Profile links, own site and results of a made listing for each page."""
    k = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<html><body><div>Find <a href="/url?q=https%3A%2F%2Fr'), k, F.lit('.example.com%2F&x=1"><h3>Result '), k, F.lit('</h3></a> about it</div><a href="https://clutch.co/profile/p'), k, F.lit('?x=1#y">P</a><a href="/profile/q'), k, F.lit('/">Q</a><a href="/profile/q'), k,
        F.lit('">again</a><a href="https://facebook.com/company/x">no</a><a href="https://o'), k, F.lit('.example.org/company/z">Visit Website</a><a href="#top">t</a></body></html>'),
    )
    base = F.lit("https://clutch.co/agencies")
    d = _table(spark, sf_dir, "pages", "page_id").select("page_id", H.parsed(html).alias("p"))
    site, found = H.company_website(F.col("p"), base), H.search_results(F.col("p"))
    return d.select("page_id", F.array_join(H.directory_links(F.col("p"), base), " ").alias("links"), site["website"].alias("website"), site["source"].alias("source"), found["parser"].alias("parser"), found["results"][0]["url"].alias("first"), found["results"][0]["snippet"].alias("snippet"))


def made_answers(spark, sf_dir):
    """Classes and states of made answers, one set for each nation."""
    cases = ("", "g-recaptcha", "unusual traffic", "cookie consent", "enablejs", "log in to your account", "no results found for x", "ai overview", "knowledge panel", "people also ask", '<div id="search">', '<div class="g"><meta viewport mobile>', "nothing", "b_results", "bnp_container", "sv_role=1")
    d = _cases(_table(spark, sf_dir, "nation", "n_nationkey"), cases, html=None)
    status = F.when(F.col("n_nationkey") % 10 == 3, 429).when(F.col("n_nationkey") % 10 == 4, 403).otherwise(200)
    provider = F.when(F.col("n_nationkey") % 2 == 0, F.lit("google_html")).otherwise(F.lit("bing"))
    s = C.answer_status(provider, F.col("html"), status, F.lit("https://s.example.com"), (F.col("n_nationkey") % 5).cast("long") * (F.col("case") % 2))
    return d.select("n_nationkey", "case", C.answer_class(F.col("html"), status, F.lit("https://s.example.com"))["kind"].alias("kind"), s["status"].alias("status"), s["classification"].alias("classification"))


QUERIES = {f.__name__: f for f in (
    page_types_made, url_judgements, company_rejections, guessed_companies, name_rules, keyword_classes, error_classes, ranked_emails, text_industries, real_html, contact_queries, search_plan, company_queries, closest_domains, priority_queue, provider_scores,
    parser_report, parser_extremes, source_ratings, template_roi, score_folds, throttle_rates, streak_breakers, crawl_budgets, made_directory, made_answers,
)}

# --- SQL ------------------------------------------------------------------------------
_URLS = f"(SELECT n_nationkey, c.* FROM nation, (VALUES {_values(URLS)}) c(\"case\", url, title))"
_NETLOC = f"lower({_part(2)})"
_LABEL = "CASE " + " ".join(f"WHEN contains(h, '{k}') THEN '{v}'" for k, v in (("linkedin.com", "LinkedIn"), ("clutch.co", "Clutch"), ("goodfirms.co", "GoodFirms"), ("justdial.com", "Justdial"), ("crunchbase.com", "Crunchbase"), ("wellfound.com", "Wellfound"), ("angel.co", "AngelList"), ("apollo.io", "Apollo"), ("zoominfo.com", "ZoomInfo"))) + " ELSE 'Google' END"
_GOV = r"(regexp_matches(h, '\.gov$|\.gov\.(in|uk|au|us|ca|sg)$|\.nic\.in$|\.govt\.nz$') OR list_contains(string_split(h, '.'), 'gov'))"
_FORUM = r"regexp_matches(u, 'reddit\.com|quora\.com|stackoverflow\.com|stackexchange\.com|zhihu\.com|medium\.com|dev\.to|hashnode\.dev|hackernews\.com|news\.ycombinator\.com')"
_CAP = "array_to_string(list_transform(list_filter(string_split_regex({0}, '[-_]+'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
_PROFILE = "CASE " + " ".join(f"WHEN contains(h, '{d}') AND contains(p, '{s}') AND len(ps) > 1 THEN {_CAP.format('ps[2]')}" for d, s in (("clutch.co", "profile"), ("goodfirms.co", "company"), ("linkedin.com", "company"), ("wellfound.com", "company"), ("crunchbase.com", "organization"), ("zoominfo.com", "c"), ("apollo.io", "companies"))) + " ELSE '' END"
_BRANDS = (("abb", "ABB"), ("adobe", "Adobe"), ("amazon", "Amazon"), ("automationanywhere", "Automation Anywhere"), ("aws", "AWS"), ("bosch", "Bosch"), ("freshworks", "Freshworks"), ("ge", "GE"), ("google", "Google"), ("hcl", "HCL"), ("hp", "HP"), ("ibm", "IBM"), ("infosys", "Infosys"), ("microsoft", "Microsoft"), ("openai", "OpenAI"), ("oracle", "Oracle"), ("rockwellautomation", "Rockwell Automation"), ("salesforce", "Salesforce"), ("sap", "SAP"), ("siemens", "Siemens"), ("tcs", "TCS"), ("uipath", "UiPath"), ("wipro", "Wipro"), ("zoho", "Zoho"))
_BRAND = "CASE tok " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _BRANDS) + " ELSE {0} END"
_HOST_NAME = f"CASE WHEN {PLATFORM_SQL} OR tok = '' THEN '' ELSE {_BRAND.format(_CAP.format('tok'))} END"
_T = typed_sql(_URLS)
_NAMED = f"(SELECT *, {_HOST_NAME} AS hname, {_PROFILE} AS prof FROM (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS ps FROM {_T}))"
_INFO = r"admission|college|universit|fees|placement|syllabus|scholarship|exam|entrance|cutoff|tutorial|course|learn|documentation|docs|guide|introduction|beginner|cheatsheet|how to|step by step|wikipedia|definition|what is|meaning|overview|history|encyclopedia|explained|types of|blog|news|article|magazine|podcast|forum|community|discussion|question|answer|faq|thread|ranking|top 10|top 5|top 7|top 15|top 20|comparison|best |vs |versus|review|jobs|careers|hiring|vacanc|internship"
_HINTS = "agency|automation|companies|company|consulting|consultancy|corp|enterprise|firm|group|inc|industrial|industries|limited|llc|ltd|provider|services|software|solutions|startup|systems|technologies|technology|ventures"
_PENALTY = " + ".join(f"CASE WHEN contains(x, '{k}') THEN {v} ELSE 0 END" for k, v in (("wikipedia", 40), ("college", 30), ("university", 30), ("admission", 30), ("fees", 30), ("placement", 30), ("ranking", 30), ("rankings", 30), ("blog", 25), ("tutorial", 25), ("course", 25), ("documentation", 25), ("news", 20), ("magazine", 20), ("forum", 20), ("community", 15)))
_NOISE = "'ambitionbox', 'capterra', 'clutch', 'crunchbase', 'g2', 'getapp', 'glassdoor', 'goodfirms', 'indeed', 'justdial', 'linkedin', 'naukri', 'trustpilot', 'zoominfo'"
_PLACEHOLDERS = "'about us', 'contact', 'contact us', 'home', 'homepage', 'products', 'services', 'founder', 'ceo', 'leadership', 'team', 'our team', 'about', 'portfolio', 'careers', 'privacy policy', 'terms of service', 'welcome', 'about the company'"
_TIDY = r"regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '^[ \-|:.,]+|[ \-|:.,]+$', '', 'g')"
_PARTS = f"list_filter(list_transform(string_split_regex({_TIDY.format('{0}')}, '\\s+\\|\\s+|\\s+[-–]\\s+|\\s+:\\s+|:\\s+'), lambda x: {_TIDY.format('x')}), lambda x: x <> '')"
_SENTENCE = "(contains({0}, '?') OR regexp_matches(lower({0}), '^(what|how|why|when|where|which|top|best|is|are|the|a) ') OR regexp_matches(lower({0}), 'tutorial|guide|definition|vs|versus|comparison|meaning|overview|documentation|reference'))"
_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_INTENT_WORDS = {
    "company": "company companies agency agencies startup startups firm firms business businesses consultancy corp corporation enterprise enterprises software technology technologies solutions solution services provider providers vendor vendors manufacturer manufacturers group inc ltd llc pvt industry industries",
    "job_role": "engineer engineers developer developers designer designers manager managers director directors founder founders ceo cto coo cfo cmo president consultant consultants architect architects freelancer freelancers recruiter recruiters analyst analysts intern interns scientist scientists researcher researchers programmer programmers specialist specialists executive executives officer officers administrator administrators hr",
    "technology": "python java javascript typescript golang go rust c++ c# php ruby scala kotlin swift react angular vue django flask fastapi spring node nodejs next.js nuxt kubernetes docker terraform ansible aws azure gcp tensorflow pytorch scikit-learn opencv sql postgresql mysql mongodb redis elasticsearch blockchain ethereum solidity rpa uipath tableau powerbi looker dbt hadoop spark kafka airflow android ios flutter ai ml nlp llm gpt selenium cypress playwright devops ci/cd jenkins",
    "person": "engineer developer designer manager director founder ceo cto coo cfo president consultant architect freelancer recruiter hr marketing sales analyst intern",
}
_HAS = {k: "list_has_any(w, [" + ", ".join(f"'{x}'" for x in v.split()) + "])" for k, v in _INTENT_WORDS.items()}
_EV = "(SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"


def _count(words: str, col: str = "t") -> str:
    return " + ".join(f"CASE WHEN contains({col}, '{w.strip()}') THEN 1 ELSE 0 END" for w in words.split(","))


_INDUSTRY = (
    ("Artificial Intelligence", "ai,artificial intelligence,machine learning,deep learning,llm,generative,neural network,natural language processing,computer vision"), ("Industrial Automation", "automation,rpa,robotic process,industrial automation,plc,scada,hmi,dcs,iot,iiot"),
    ("Mechanical Engineering", "mechanical engineering,mechanical,hvac,thermal,fluid dynamics,manufacturing engineering"), ("Civil Engineering", "civil engineering,infrastructure,structural,construction,geotechnical,transportation"),
    ("Software Development", "software development,app development,web development,devops,agile,full stack,backend,frontend"), ("Cloud Computing", "cloud,aws,azure,gcp,saas,paas,iaas,kubernetes,docker"), ("Cybersecurity", "cybersecurity,security,infosec,soc,penetration testing,firewall,compliance"),
    ("Healthcare", "healthcare,medical,pharma,hospital,clinical,biotech,medtech,health tech"), ("Finance", "fintech,banking,financial services,insurance,investment,payment processing"), ("Electrical Engineering", "electrical engineering,power systems,semiconductor,electronics,embedded systems"),
    ("Chemical Engineering", "chemical engineering,process engineering,petrochemical,polymer,refinery"), ("Logistics", "logistics,supply chain,shipping,warehouse,freight,last mile"), ("EdTech", "edtech,e-learning,online learning,lms,education technology"),
)
_TYPE = (
    ("AI Startup", "artificial intelligence|machine learning|deep learning|llm|generative ai|neural network|nlp"), ("Software Company", "saas|software|platform|cloud|app|application|erp|crm|devops|api"), ("Consultancy", "consulting|consultancy|advisory"), ("Agency", "agency"),
    ("Manufacturer", "manufacturer|manufacturing|production|fabrication|oem|factory"), ("Industrial", "industrial|automation|robotics|plc|scada|engineering|heavy industry"), ("Healthcare", "healthcare|hospital|medical|pharma|clinical|biotech|medtech"),
    ("Finance", "financial|fintech|banking|insurance|investment|payment|trading|wealth"), ("Marketplace", "marketplace|ecommerce|e-commerce|retail|store|shop"), ("Telecom", "telecom|network|connectivity|broadband|wireless"), ("Construction", "construction|infrastructure|civil|real estate|architecture|contractor"),
    ("Legal", "law firm|legal|attorney|solicitor|compliance"), ("Education Company", "edtech|e-learning|lms|learning management|online education"),
)
_ORG = (
    ("B2B Software", "b2b|enterprise|saas|software engineering|solutions provider|it services"), ("B2C/Marketplace", "shop|store|buy|cart|consumer|ecommerce|marketplace|shipping|retail"), ("NGO", "non-profit|charity|donation|ngo|association|society"),
    ("Education", "syllabus|course|university|college|academy|learn|tutorial"), ("Consultancy", "consulting|consultancy|agency|firm|services firm"),
)
_best = lambda rows: "list_reduce([" + ", ".join(f"{{'s': {s}, 'n': '{n}'}}" for n, s in rows) + "], lambda a, b: CASE WHEN b.s > a.s THEN b ELSE a END)"
# \b of the library takes letters with marks as part of a word, RE2's doesn't: so count words between other characters
_ORG_COUNT = r"len(regexp_extract_all(regexp_replace(t, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])(?:{0})(?:$|[^\p{{L}}\p{{N}}_])'))"
_VARIANTS = "[k, k || ' companies', k || ' startups', k || ' solutions', k || ' agency']"

ORACLES = {
    "page_types_made": f"SELECT n_nationkey, \"case\", k AS kind, CASE WHEN url = '' THEN 'REJECT' ELSE {CLASS_SQL} END AS class, {LISTED_SQL} AS listed FROM (SELECT *, {PAGE_TYPE_SQL} AS k FROM {_T})",
    "url_judgements": f"SELECT n_nationkey, \"case\", {_GOV} AS government, {_FORUM} AS forum, {_LABEL} AS source, prof AS profile, hname AS host_name, tok AS token FROM {_NAMED}",
    "company_rejections": f"""SELECT n_nationkey, "case", CASE WHEN title = '' THEN 'missing company name' WHEN length(title) < 2 THEN 'company name too short' WHEN regexp_matches(t, '{_INFO}') THEN 'company name looks informational'
        WHEN k IN ('ARTICLE', 'BLOG', 'DIRECTORY_LIST') THEN lower(k) || ' page rejected' WHEN url <> '' AND ({_GOV} OR {_FORUM}) THEN 'government or forum URL rejected'
        WHEN url <> '' AND NOT {PLATFORM_SQL} AND regexp_extract(h, '[^.]*$') NOT IN ('ai', 'app', 'biz', 'co', 'com', 'in', 'info', 'io', 'net', 'org', 'tech') THEN 'unsupported website domain suffix' END AS company,
        CASE WHEN length(title) < 2 THEN 'company name too short' WHEN "case" % 10 = 9 THEN 'company classified as educational' WHEN regexp_matches(t, '{_INFO}') THEN 'company name contains informational term: ''' || CASE WHEN contains(t, 'tutorial') THEN 'tutorial' WHEN contains(t, 'what is') THEN 'what is' WHEN contains(t, 'best ') THEN 'best ' ELSE '?' END || ''''
        WHEN ptok IN (SELECT unnest(string_split('quora stackoverflow github facebook linkedin medium forbes wikipedia indeed glassdoor google apple dev', ' '))) AND ptok <> 'facebook' THEN 'website domain ''' || ptok || ''' is a blocked non-company site'
        WHEN {_PENALTY} + CASE WHEN {LISTED_SQL} THEN 30 ELSE 0 END >= 40 THEN 'quality penalty ' || ({_PENALTY} + CASE WHEN {LISTED_SQL} THEN 30 ELSE 0 END) || ' exceeds threshold' END AS lead
        FROM (SELECT *, {PAGE_TYPE_SQL} AS k, CASE WHEN len(l) < 2 THEN coalesce(l[1], '') ELSE l[-2] END AS ptok, lower(title || ' ' || url || ' google ') AS x FROM {_T})""",
    "guessed_companies": f"""WITH a AS (SELECT *, CASE WHEN hname = '' AND {PLATFORM_SQL} THEN prof ELSE hname END AS d, list_filter({_PARTS.format('title')}, lambda x: lower(x) NOT IN ({_NOISE})) AS c FROM {_NAMED}),
        b AS (SELECT *, list_filter(c, lambda x: regexp_matches(lower(x), '{_HINTS}')) AS biz, list_filter(c, lambda x: NOT {_SENTENCE.format('x')}) AS nf FROM a),
        g AS (SELECT *, CASE WHEN len(nf) > 0 THEN nf[-1] ELSE d END AS guess FROM b)
        SELECT n_nationkey, "case", {_BRAND.format(f'''CASE WHEN title = '' THEN d WHEN d <> '' AND (regexp_matches(t, '{_INFO}') OR len(list_filter(c, lambda x: {_PLAIN.format('x')} = {_PLAIN.format('d')} AND {_PLAIN.format('x')} <> '')) > 0) THEN d
        WHEN len(biz) > 0 THEN CASE WHEN d <> '' THEN d ELSE biz[1] END WHEN length(trim(guess)) >= 2 AND lower(trim(guess)) NOT IN ({_PLACEHOLDERS}) THEN guess ELSE d END''')} AS name FROM g""",
    "ranked_emails": "SELECT n_nationkey, array_to_string(list_transform(list_sort(list_transform(list_filter(list_filter(e, lambda x, i: (i - 1 + n_nationkey) % 3 <> 0), lambda x: NOT regexp_matches(split_part(lower(x), '@', 1), 'noreply|no-reply|no_reply|donotreply|do-not-reply|bounce|unsubscribe|notification|tracking|newsletter|mailer|maildaemon|mail-daemon|postmaster|marketing|automated|system|alert|webmaster')), lambda x: {'r': CASE WHEN starts_with(lower(x), 'founder') THEN 0 WHEN starts_with(lower(x), 'ceo') THEN 1 WHEN starts_with(lower(x), 'sales') THEN 2 WHEN starts_with(lower(x), 'business') THEN 3 WHEN starts_with(lower(x), 'partnership') THEN 4 WHEN starts_with(lower(x), 'bd') THEN 5 WHEN starts_with(lower(x), 'hello') THEN 6 WHEN starts_with(lower(x), 'info') THEN 7 WHEN starts_with(lower(x), 'contact') THEN 8 WHEN starts_with(lower(x), 'support') THEN 9 ELSE 10 END, 'e': x})), lambda y: y.e), ' ') AS emails FROM (SELECT n_nationkey, [" + ", ".join(f"'{e}'" for e in EMAILS) + "] AS e FROM nation)",
    "keyword_classes": f"""SELECT n_nationkey, "case", CASE WHEN {_HAS['company']} THEN 'company' WHEN {_HAS['job_role']} THEN 'job_role' WHEN {_HAS['technology']} OR k IN ('automation anywhere', 'blue prism', 'power bi', 'react native') THEN 'technology'
        WHEN k IN ('crm', 'erp', 'hrms', 'hris', 'cms', 'lms', 'saas', 'paas', 'iaas', 'pos', 'chatbot', 'helpdesk', 'ticketing', 'dashboard') THEN 'product' WHEN k IN ('digital marketing', 'seo', 'sem', 'ppc', 'smm', 'staffing', 'recruitment', 'outsourcing') THEN 'service' ELSE 'industry' END AS intent,
        CASE WHEN {_HAS['person']} THEN 'person' ELSE 'company' END AS category, CASE WHEN NOT contains(k, 'site:') AND len(w) <= 4 THEN 1.0 WHEN contains(k, 'site:') AND NOT contains(k, '"') AND len(w) <= 5 THEN 0.6 ELSE 0.2 END::DOUBLE AS expectation,
        CASE WHEN ends_with(q, 's') AND NOT ends_with(q, 'ss') THEN left(q, length(q) - 1) ELSE q END AS key
        FROM (SELECT *, string_split(k, ' ') AS w, replace(replace(k, 'companies', 'company'), 'firms', 'firm') AS q FROM (SELECT n_nationkey, "case", lower(CASE WHEN n_nationkey % 2 = 0 THEN word ELSE word || ' ' || n_name END) AS k FROM nation, (VALUES {_values(KEYWORDS)}) c("case", word)))""",
    "error_classes": f"""SELECT kind, CASE WHEN kind IN ('captcha', 'sorry_page', 'enablejs', 'consent_page') THEN 'GOOGLE_CAPTCHA' WHEN kind = 'rate_limit' THEN 'GOOGLE_429' WHEN kind IN ('tls_failure', 'certificate_failure') THEN 'TRANSPORT_TLS_ERROR' WHEN kind = 'timeout' THEN 'TRANSPORT_TIMEOUT' WHEN kind = 'dead_connection' THEN 'TRANSPORT_CONNECTION_ERROR' END AS outcome, count(*) AS n
        FROM (SELECT CASE WHEN contains(m, 'captcha') THEN 'captcha' WHEN contains(m, 'sorry') THEN 'sorry_page' WHEN contains(m, 'enablejs') THEN 'enablejs' WHEN contains(m, 'consent') THEN 'consent_page' WHEN contains(m, 'parse') THEN 'parser_failure' WHEN contains(m, 'zero') THEN 'zero_results'
          WHEN regexp_matches(m, 'certificate|ssl cert|local issuer|self signed') THEN 'certificate_failure' WHEN regexp_matches(m, 'ssl|tls|handshake') THEN 'tls_failure' WHEN regexp_matches(m, 'timeout|timed out|deadline|curl: \\(28\\)') THEN 'timeout'
          WHEN regexp_matches(m, 'connection closed|connection reset|connection refused|connect failed|proxy connect aborted|rejected by the socks5 server|curl: \\(56\\)|curl: \\(97\\)') THEN 'dead_connection' WHEN regexp_matches(m, '429|rate limit|too many requests') THEN 'rate_limit' ELSE 'generic' END AS kind
          FROM (SELECT lower([{", ".join(f"'{e}'" for e in ERRORS)}][event_id % {len(ERRORS)} + 1]) AS m FROM events)) GROUP BY kind""",
    "text_industries": f"""SELECT doc_id, CASE WHEN i.s > 0 THEN i.n ELSE 'Unknown' END AS industry, CASE {" ".join(f"WHEN regexp_matches(t, '{w}') THEN '{n}'" for n, w in _TYPE)} ELSE 'Unknown' END AS company_type, CASE WHEN o.s > 0 THEN o.n ELSE 'B2B Software' END AS organisation
        FROM (SELECT doc_id, t, {_best([(n, _count(w)) for n, w in _INDUSTRY])} AS i, {_best([(n, _ORG_COUNT.format(w)) for n, w in _ORG])} AS o FROM (SELECT doc_id, lower(text) AS t FROM documents))""",
    "real_html": """SELECT page_id, page_id % 7 <> 0 AND NOT regexp_matches(left(lower(CASE page_id % 5 WHEN 0 THEN '<p>Just a Moment</p>' WHEN 1 THEN repeat('x', 4090) || 'recaptcha' ELSE '' END || html), 4096),
        'cf-browser-verification|just a moment|enable javascript and cookies to continue|/_cf/|challenge-platform|ddos-guard|perimeterx|px-captcha|window\\._cf_chl|challenge-error-title|recaptcha') AS real FROM pages""",
    "contact_queries": """SELECT s_suppkey, CAST(i - 1 AS INT) AS place, query FROM (SELECT s_suppkey, unnest(q) AS query, generate_subscripts(q, 1) AS i FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN [] ELSE
        CASE WHEN s_suppkey % 3 = 0 THEN [] ELSE ['site:linkedin.com/in "' || s_name || '" founder OR CEO OR director', 'site:linkedin.com/in "' || s_name || '" "co-founder"', '"' || s_name || '" site:linkedin.com'] END
        || ['"' || s_name || '" "our team" OR "meet the team" OR "leadership"', '"' || s_name || '" "about us" founder CEO'] || CASE WHEN s_suppkey % 2 = 0 THEN [] ELSE ['"' || s_name || '" contact email phone'] END END AS q FROM supplier))""",
    "search_plan": """WITH k AS (SELECT DISTINCT lower(p_name) AS n, p_partkey % 2 = 0 AS placed FROM part), l AS (SELECT n, CASE WHEN placed THEN n || ' Pune' ELSE n END AS keyword, CASE WHEN placed THEN ' Pune' ELSE '' END AS l FROM k),
        t AS (SELECT keyword, unnest([{'o': 1, 's': 'google', 'q': CASE WHEN l = '' THEN keyword ELSE n || l END}] || list_transform(['google|#company', 'google|#services', 'google|#solutions', 'google|#consulting', 'google|intitle:#', 'linkedin|site:linkedin.com/company #', 'clutch|site:clutch.co #', 'goodfirms|site:goodfirms.co #', 'github|site:github.com #development',
          'google|#software companies', 'google|#startups', 'google|#software company', 'google|#development company', 'google|custom #development', 'brave|#outsourcing', 'brave|enterprise #solutions', 'duckduckgo|custom #solutions'],
          lambda x, i: {'o': i + 1, 's': split_part(x, '|', 1), 'q': trim(regexp_replace(replace(split_part(x, '|', 2), '#', n || ' '), '\\s+', ' ', 'g')) || l})) AS t FROM l)
        SELECT keyword, t.s AS source, t.q AS query, CAST(row_number() OVER (PARTITION BY keyword ORDER BY t.o) AS INT) AS priority FROM t""",
    "company_queries": f"""WITH k AS (SELECT DISTINCT lower(p_name) AS k FROM part), v AS (SELECT k, {_VARIANTS} AS v FROM k),
        b AS (SELECT k, 'b2b' AS kind, flatten(list_transform(v, lambda x: [x || ' Pune', '"' || x || '" "Pune"', 'top ' || x || ' in Pune', x || ' Pune website', x || ' Pune pvt ltd'])) || flatten(list_transform(['site:linkedin.com/company', 'site:justdial.com', 'site:indiamart.com'], lambda s: flatten(list_transform(v, lambda x: [s || ' ' || x || ' Pune', s || ' "Pune" ' || x])))) || flatten(list_transform(v, lambda x: [x || ' Pune -jobs -career -hiring', x || ' Pune -job -hiring'])) AS q FROM v
          UNION ALL SELECT k, 'b2c', flatten(list_transform(v, lambda x: [x || ' near Pune', x || ' Pune contact', x || ' Pune phone number', '"' || x || '" "Pune"', 'site:justdial.com ' || x || ' Pune', 'site:yellowpages.com ' || x || ' Pune', 'site:sulekha.com ' || x || ' Pune'])) FROM v),
        r AS (SELECT k, kind, unnest(q) AS query, generate_subscripts(q, 1) AS o FROM b)
        SELECT k AS keyword, 'Pune' AS location, query, CAST(place AS INT) AS place, kind FROM (SELECT *, row_number() OVER (PARTITION BY k, kind ORDER BY CASE WHEN contains(query, 'site:') THEN 0.65 WHEN starts_with(query, '"') THEN 0.95 ELSE 1.0 END DESC, o) AS place FROM r) WHERE place <= 60""",
    "closest_domains": """WITH o AS (SELECT CAST(n_regionkey AS VARCHAR) AS domain, lower(n_name) AS term, n_nationkey AS ordinal FROM nation), k AS (SELECT DISTINCT unnest([lower(left(n_name, 2)), lower(n_name), lower(right(n_name, 3))]) AS keyword FROM nation),
        m AS (SELECT keyword, domain, row_number() OVER (PARTITION BY keyword ORDER BY term <> keyword, length(term), ordinal) AS rn FROM k JOIN o ON contains(term, keyword)) SELECT keyword, domain FROM k LEFT JOIN (SELECT * FROM m WHERE rn = 1) USING (keyword)""",
    "priority_queue": "SELECT o_orderkey AS seq, o_orderstatus AS provider, p AS priority, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY p DESC, o_custkey % 3, o_orderdate, o_orderkey) AS INT) AS rank FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 9 ELSE CAST(left(o_orderpriority, 1) AS INT) END AS p FROM orders)",
    "provider_scores": """WITH g AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS q, count(*) FILTER (event_type = 'purchase') AS l, count(*) FILTER (event_type = 'signup') AS a, count(*) FILTER (event_type = 'error') AS f, avg(value) AS v FROM events GROUP BY user_id),
        s AS (SELECT *, 35 * l / q + 20 * a / q + 10 * (q - f) / q + 0.25 * greatest(0, 100 - v / 10 * 8) + 0.1 * greatest(0, 100 - 100 * f / q) AS b FROM g),
        p AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END AS rate, user_id % 7 * 1000 + user_id AS pos FROM g)
        SELECT user_id, round_even(greatest(1, least(100, CASE WHEN q < 3 THEN greatest(20, b) ELSE b END + 15 / sqrt(q) - CASE WHEN user_id % 3 > 0 THEN 20.0 * (user_id % 3) ELSE 0 END)), 9) AS score,
        CAST(row_number() OVER (ORDER BY pos + CASE WHEN rate < 0.2 THEN 10 WHEN rate > 0.8 AND pos > 0 AND user_id % 2 = 0 THEN -1 ELSE 0 END + CASE WHEN user_id % 11 = 0 THEN 100 ELSE 0 END, rate DESC, pos) AS INT) AS place FROM s JOIN p USING (user_id)""",
    "parser_report": "SELECT event_type || '-' || day(ts) AS parser, count(*) FILTER (user_id % 3 > 0) AS successes, count(*) FILTER (user_id % 3 = 0) AS failures, round_even(avg(CAST(user_id % 3 > 0 AS INT)), 9) AS success_rate, round_even(coalesce(avg(value) FILTER (user_id % 3 > 0), 0), 9) AS avg_time_ms FROM events GROUP BY 1",
    "parser_extremes": "WITH r AS (SELECT event_type AS p, avg(CAST(user_id % 3 > 0 AS INT)) AS s FROM events GROUP BY 1) SELECT (SELECT p FROM r ORDER BY s DESC, p LIMIT 1) AS best, (SELECT p FROM r ORDER BY s, p LIMIT 1) AS worst, (SELECT round_even(avg(value), 9) FROM events WHERE user_id % 3 > 0) AS avg_parse_ms",
    "source_ratings": """WITH f AS (SELECT user_id, CAST(sum(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 WHEN 'view' THEN -1 WHEN 'click' THEN 1 ELSE -3 END) AS DOUBLE) AS p, count(*) AS n, count(*) FILTER (event_type IN ('view', 'error') AND (last IS NULL OR event_id > last)) AS x
          FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS last FROM events) GROUP BY user_id)
        SELECT user_id, round_even(p / n, 9) AS score, CASE WHEN p / n >= 3 THEN 5 WHEN p / n >= 1 THEN 4 WHEN p / n >= 0 THEN 3 WHEN p / n >= -1 THEN 2 ELSE 1 END AS stars, n AS queries_run,
        round_even(CASE WHEN x * 10 >= 30 THEN greatest(0.001, 1 - 0.999 * exp(-0.02 * (user_id % 50))) WHEN x * 15 >= 50 THEN greatest(0.001, 1 - 0.999 * exp(-0.02 * (user_id % 7))) ELSE greatest(0.2, least(2.0, 1 + 0.1 * p / n)) END, 9) AS weight FROM f""",
    "template_roi": """SELECT template, count(*) AS runs, count(*) FILTER (event_type = 'purchase') AS leads, round_even(avg(CAST(event_type = 'purchase' AS INT)), 9) AS roi
        FROM (SELECT *, ['best {keyword} {location}', 'top {keyword} {location}', 'site:clutch.co "{keyword}" {location}', 'site:clutch.co "{keyword}"', 'site:github.com "{keyword}" {location}', NULL][event_id % 6 + 1] AS template FROM events) WHERE template IS NOT NULL GROUP BY 1""",
    "score_folds": f"""WITH RECURSIVE e AS (SELECT user_id, i, CASE event_type WHEN 'error' THEN -10.0 WHEN 'view' THEN -5.0 WHEN 'click' THEN 0.0 ELSE 8.0 END AS d FROM {_EV}),
        f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(100.0 AS DOUBLE) AS s FROM events UNION ALL SELECT f.user_id, e.i, least(100.0, greatest(0.0, f.s + e.d)) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT user_id, arg_max(s, i) AS score, max(i) AS events FROM f GROUP BY user_id""",
    "throttle_rates": f"""WITH RECURSIVE e AS (SELECT user_id, i, event_type AS k, value / 10 AS t FROM {_EV}),
        f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(1.0 AS DOUBLE) AS s FROM events UNION ALL SELECT f.user_id, e.i, CASE WHEN k = 'error' THEN greatest(0.05, s * 0.4) WHEN k = 'signup' THEN greatest(0.05, s * 0.5) WHEN t > 2 THEN greatest(0.1, s * 0.8) WHEN t < 0.8 THEN least(2.0, s * 1.1) ELSE s END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
        SELECT user_id, round_even(arg_max(s, i), 9) AS rate FROM f GROUP BY user_id""",
    "streak_breakers": f"""WITH RECURSIVE e AS (SELECT user_id, i, CAST(sec AS DOUBLE) AS t, event_type = 'error' AS f FROM {_EV}),
        s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS INT) AS n, CAST(0 AS DOUBLE) AS u, CAST(0 AS BIGINT) AS o, CAST(0 AS BIGINT) AS k FROM events UNION ALL
          SELECT user_id, i, CASE WHEN shut THEN n WHEN f THEN c + 1 ELSE 0 END, CASE WHEN shut THEN u WHEN f AND c + 1 >= 2 THEN t + 172800 ELSE 0 END, o + CAST(NOT shut AND f AND c + 1 >= 2 AS BIGINT), k + CAST(shut AS BIGINT)
          FROM (SELECT s.user_id, e.i, e.t, e.f, s.n, s.u, s.o, s.k, e.t < s.u AS shut, CASE WHEN s.u > 0 AND e.t >= s.u THEN 0 ELSE s.n END AS c FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
        SELECT user_id, arg_max(o, i) AS opens, arg_max(k, i) AS skipped, arg_max(n, i) AS streak FROM s GROUP BY user_id""",
    "crawl_budgets": f"""SELECT page_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY {CRAWL_SQL} ORDER BY page_id) AS one, regexp_replace({_NETLOC}, '^www\\.', '') AS domain FROM pages) WHERE one = 1) WHERE rn <= 4""",
    "made_directory": """SELECT page_id, 'https://clutch.co/profile/p' || page_id || ' https://clutch.co/profile/q' || page_id || ' https://o' || page_id || '.example.org/company/z' AS links, 'https://o' || page_id || '.example.org/company/z' AS website, 'clutch' AS source,
        'SemanticParser' AS parser, 'https://r' || page_id || '.example.com/' AS first, 'Find  about it' AS snippet FROM pages""",
}

#: What each made name stands for: phrase, name, canonical, parts, person, concept, letters for domains, article.
_NAME_ROWS = (
    (1, 1, "What is Acme", "What is Acme", "What is Acme", "What Is Acme", "whatisacme", 1), (1, 1, "Acme Guide", "Acme Guide", "Acme Guide", "Acme Guide", "acmeguide", 1), (1, 1, "Acme", "Acme?", "Acme?", "Acme?", "acme", 0), (1, 1, "The Acme", "The Acme", "The Acme", "The Acme", "theacme", 0),
    (0, 1, "Acme", "Acme", "Acme", "Acme", "acme", 0), (1, 1, "Versus Labs", "Versus Labs", "Versus Labs", "Versus Labs", "versuslabs", 0), (0, 1, "Acme", "Acme Pvt Ltd", "Acme Pvt Ltd", "Acme Pvt Ltd", "acme", 0), (0, 0, "home", "home", "home", "Home", "home", 0), (0, 0, "A", "A", "A", "A", "a", 0),
    (0, 0, "About Us", "About Us", "About Us", "About Us", "aboutus", 0), (1, 1, "Is it", "Is it", "Is it", "Is It", "isit", 0), (1, 1, "overviews", "overviews", "overviews", "Overviews", "overviews", 0), (0, 1, "Acme Tools - Home x", "Acme#Tools#Home#x", "Acme", "Acme | Tools - Home: X", "acmetoolshomex", 0),
    (0, 1, "- Acme -", "Acme", "", "- Acme -", "acme", 0), (0, 1, "ab c", "a:b c", "a:b c", "A:B C", "abc", 0), (0, 1, "IBM", "IBM India Pvt. Ltd", "IBM India Pvt. Ltd.", "Ibm India Pvt. Ltd.", "ibmindia", 0),
    (0, 1, "Rockwell Automation", "Rockwell Automation Inc", "Rockwell Automation Inc", "Rockwell Automation Inc", "rockwellautomation", 0), (0, 1, "Ann Lee - CEO - Acme In", "Ann Lee#CEO#Acme#In", "Ann Lee", "Ann Lee - Ceo - Acme | In", "annleeceoacmein", 0), (0, 1, "Bo Jr", "Bo, Jr", "Bo", "Bo, Jr", "bojr", 0),
    (0, 1, "machine learning v21", "machine learning v2.1", "machine learning v2.1", "ML", "machinelearningv21", 0), (0, 1, "robots v3", "robots v3", "robots v3", "Robots V3", "robotsv3", 0), (0, 1, "internet of things", "internet of things", "internet of things", "IoT", "internetofthings", 0), (0, 0, "", "", "", "", "", 0),
)
ORACLES["name_rules"] = f"""SELECT n_nationkey, "case", s = '1' AS sentence, c = '1' AS company, canonical, parts, person, concept, CASE WHEN d = '' THEN '' ELSE array_to_string(list_transform(['.com', '.in', '.co.in', '.io', '.org', '.ai'], lambda x: d || x), ' ') END AS domains, a = '1' AS article
    FROM nation, (VALUES {_values([tuple(str(x) for x in r) for r in _NAME_ROWS])}) v("case", s, c, canonical, parts, person, concept, d, a)"""
ORACLES["made_answers"] = """SELECT n_nationkey, "case", kind,
    CASE WHEN "case" = 0 THEN 'NETWORK_FAILURE' WHEN status = 429 THEN 'RATE_LIMIT' WHEN n_nationkey % 2 = 0 THEN CASE WHEN status = 403 THEN 'FORBIDDEN' WHEN kind = 'CAPTCHA_PAGE' THEN 'CAPTCHA' WHEN kind = 'ENABLE_JS_PAGE' THEN 'ENABLE_JS' WHEN kind = 'CONSENT_PAGE' THEN kind WHEN kind = 'ZERO_RESULTS_PAGE' THEN 'VALID_ZERO_RESULTS'
      WHEN r > 0 THEN 'VALID_RESULTS' WHEN "case" BETWEEN 7 AND 11 THEN 'PARSER_FAILURE' ELSE 'UNKNOWN_LAYOUT' END ELSE CASE WHEN "case" IN (1, 15) THEN 'CAPTCHA' WHEN r > 0 THEN 'VALID_RESULTS' WHEN "case" = 14 THEN 'CONSENT_PAGE' WHEN "case" = 6 THEN 'VALID_ZERO_RESULTS' WHEN "case" = 13 THEN 'PARSER_FAILURE' ELSE 'UNKNOWN_LAYOUT' END END AS status,
    CASE WHEN "case" = 0 THEN 'EMPTY_HTML' WHEN status = 429 THEN 'HTTP_429' WHEN n_nationkey % 2 = 0 THEN CASE WHEN status = 403 THEN 'FORBIDDEN_PAGE' ELSE kind END ELSE CASE WHEN "case" = 15 THEN 'MENLO_INTERCEPT' WHEN "case" = 1 THEN 'BING_CAPTCHA' WHEN r > 0 THEN 'BING_NORMAL_SERP' WHEN "case" = 14 THEN 'BING_CONSENT' WHEN "case" = 6 THEN 'BING_ZERO_RESULTS' WHEN "case" = 13 THEN 'BING_PARSER_FAILURE' ELSE 'BING_UNKNOWN_LAYOUT' END END AS classification
    FROM (SELECT *, CASE WHEN "case" = 0 THEN 'EMPTY_SERP' WHEN "case" IN (1, 15) THEN 'CAPTCHA_PAGE' WHEN status = 429 OR "case" = 2 THEN 'SORRY_PAGE' WHEN "case" BETWEEN 3 AND 11 THEN ['CONSENT_PAGE', 'ENABLE_JS_PAGE', 'LOGIN_PAGE', 'ZERO_RESULTS_PAGE', 'AI_OVERVIEW_PAGE', 'KNOWLEDGE_PANEL_PAGE', 'PEOPLE_ALSO_ASK_PAGE', 'NORMAL_DESKTOP_SERP', 'NORMAL_MOBILE_SERP']["case" - 2] ELSE 'UNKNOWN_LAYOUT' END AS kind
      FROM (SELECT n_nationkey, CAST("case" AS INT) AS "case", CASE n_nationkey % 10 WHEN 3 THEN 429 WHEN 4 THEN 403 ELSE 200 END AS status, n_nationkey % 5 * ("case" % 2) AS r FROM nation, range(16) t("case")))"""
