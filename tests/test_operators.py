"""Operators and stages against plain Python models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leadweave.operators import dedup, lookup, merge, planner, ranking, stages
from leadweave.operators import telemetry as T
from leadweave.sources import readers, sinks
from leadweave.streaming import state

PEOPLE = "array<struct<name:string,designation:string>>"
LEADS = f"ord int, company_name string, website string, linkedin string, industry string, emails array<string>, phones array<string>, social_links map<string,string>, people {PEOPLE}, source string"


def lead(o, name="Valid Company", site="https://www.example.com/", emails=(), phones=(), links=None, people=(), **k):
    return (o, name, site, k.get("linkedin"), k.get("industry"), list(emails), list(phones), links or {}, list(people), k.get("source"))


def test_clean(spark):
    rows = [lead(0, "", None), lead(1, "Valid Company", None), lead(2, "Top 10 widget companies in Springfield"), lead(3, emails=["logo@2x.png", "u003einfo@example.com", "info@example"], phones=["12-34", "+1 212 555 0199"]), lead(4, " VALID company ", None), lead(5, None, None, people=[(None, "CEO"), ("Ann Example", "CEO")])]
    r = stages.clean(spark.createDataFrame(rows, LEADS))
    flags = {x.ord: x["flags"] for x in r.rejects.collect()}
    assert flags[0] == ["directory_or_article_page", "sparse_no_contact_channel"] and flags[2] == ["directory_or_article_page"]
    assert flags[3] == ["email_junk:logo@2x.png", "email_malformed:info@example", "phone_malformed:12-34"]
    assert [x.ord for x in r.kept.orderBy("ord").collect()] == [1]
    m = r.metrics.first()
    assert (m.raw, m["rows"], m.duplicates, m.clean) == (6, 4, 2, 1)
    assert {x.tag: x.n for x in stages.flag_tally(r.rejects).collect()}["email_junk"] == 1


def model_merge(rows):
    """The merge by key, record after record."""
    out = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        m = out.setdefault(r["domain"], {"company_name": None, "emails": set(), "links": {}, "people": []})
        m["company_name"] = m["company_name"] if m["company_name"] is not None else r["company_name"]
        m["emails"] |= set(r["emails"] or [])
        m["links"].update(r["links"] or {})
        for p in r["people"] or []:
            at = next((i for i, q in enumerate(m["people"]) if p[0] and q[0] == p[0]), None)
            if at is None:
                m["people"].append(p)
            else:
                m["people"][at] = p
    return out


def test_merge_by_key(spark):
    r = random.Random(2)
    rows = [{"ord": i, "domain": r.choice(["a", "b", "c"]), "company_name": r.choice([None, f"n{i}"]), "emails": r.choice([None, [f"e{r.randint(0, 3)}"]]), "links": r.choice([None, {r.choice("xy"): f"l{i}"}]), "people": r.choice([None, [(r.choice([None, "p", "q"]), f"d{i}")], [("p", f"d{i}"), (None, f"u{i}")]])} for i in range(60)]
    d = spark.createDataFrame([(x["ord"], x["domain"], x["company_name"], x["emails"], x["links"], x["people"]) for x in rows] + [(99, "", "x", None, None, None), (98, None, "x", None, None, None)], f"ord int, domain string, company_name string, emails array<string>, social_links map<string,string>, people {PEOPLE}")
    want = model_merge(rows)
    for shuffled in (d, d.orderBy(F.rand(1)).repartition(3)):
        got = {x.domain: x for x in merge.merge_by_key(shuffled).collect()}
        assert got.keys() == want.keys()
        for k, m in want.items():
            assert (got[k].company_name, got[k].emails, got[k].social_links, [tuple(p) for p in got[k].people]) == (m["company_name"], sorted(m["emails"]), m["links"], m["people"])
    # merging a merged table with itself changes nothing but the count
    once = merge.merge_by_key(d).withColumnRenamed("first_ord", "ord").drop("merged")
    assert sorted(map(str, merge.merge_by_key(once).drop("merged", "first_ord").collect())) == sorted(map(str, once.drop("ord").collect()))


def test_master_and_history(spark):
    rows = [lead(0, "One", "http://www.a.com", ["a+b@example.com", "X@Y.com"], ["(212) 555-0199"], industry="it"), lead(1, "Two", "a.com/x", ["z@y.com"]), lead(2, "No site", None), lead(3, "", "b.com"), lead(4, "Empty host", "  ")]
    r = stages.to_master(spark.createDataFrame(rows, LEADS))
    m = r.kept.collect()
    assert [(x.domain, x.company_name, x.industry, x.emails, x.phones, x.merged) for x in m] == [("a.com", "One", "IT", ["x@y.com", "z@y.com"], ["2125550199"], 2)]
    assert {x.ord: x.reject_reason for x in r.rejects.collect()} == {2: "website", 3: "company_name", 4: "no_domain"}
    again = stages.to_master(spark.createDataFrame(rows, LEADS), history=r.kept).kept.collect()
    assert [(x.domain, x.company_name, x.emails) for x in again] == [("a.com", "One", ["x@y.com", "z@y.com"])]
    assert stages.lookup(r.kept, domain="A.com").count() == 1 and stages.lookup(r.kept, industry="it").count() == 1 and stages.lookup(r.kept, domain="q").count() == 0


def test_finalize_polish_verify_enrich(spark):
    rows = [lead(0, "What is a widget", emails=["a@b.com"]), lead(1, "Acme", None), lead(2, "Acme", emails=["a@acme.com", "A@acme.com "]), lead(3, "acme ", "https://WWW.example.com/")]
    d = spark.createDataFrame(rows, LEADS)
    f = stages.finalize(d)
    assert [x.ord for x in f.kept.collect()] == [2] and {x.ord: x.drop_reason for x in f.rejects.collect()} == {0: "article_or_directory_page", 1: "no_verified_channel"}
    many = [f"x@d{i}.com" for i in range(5)]
    p = stages.polish(spark.createDataFrame([lead(0, "A", "https://a.com", many), lead(1, "B", "https://b.com", ["i@b.com", "j@c.com"]), lead(2, "C", None, people=[("x@y", "d"), ("Ann", "CEO"), ("ann ", "ceo")])], LEADS))
    assert {x.ord: (x.emails, len(x.people)) for x in p.kept.collect()} == {1: (["i@b.com"], 0), 2: ([], 1)} and [x.ord for x in p.rejects.collect()] == [0]
    mx = spark.createDataFrame([("acme.com", True, "ok")], "domain string, has_mx boolean, reason string")
    sites = spark.createDataFrame([("https://www.example.com/", 200, "")], "url string, status int, reason string")
    v = {x.ord: x for x in stages.verify(d, mx, sites).kept.collect()}
    assert v[2].verified_emails == ["A@acme.com ", "a@acme.com"][1:] or "a@acme.com" in v[2].verified_emails
    assert (v[1].website_reachable, v[2].website_reachable) == (None, True) and v[0].email_notes == {"a@b.com": "not_probed"}
    reg = spark.createDataFrame([(0, "Acme", False, "x", ""), (1, "Acme", True, "found", "ACME LTD")], "ord int, company_name string, matched boolean, reason string, registered_name string")
    who = spark.createDataFrame([("example.com", "r", "2020", "o", "US")], "domain string, registrar string, creation_date string, org string, country string")
    e = {x.ord: x for x in stages.enrich(d, reg, who).collect()}
    assert e[2].corporate_registry.reason == "found" and e[0].corporate_registry.reason == "not_processed" and e[2].whois.country == "US" and e[1].whois is None
    assert stages.coverage(d.limit(0)).first().asDict() == {"total": 0, "pct_email": 0.0, "pct_phone": 0.0}


def test_best_record_and_upsert(spark):
    d = spark.createDataFrame([(0, "IBM", 5, "blog", None, "l0"), (1, "IBM India", 9, "blog", None, None), (2, "IBM Corporation", 9, "linkedin", "", None), (3, "ibm", 1, "x", "w3", "l3")], "ord int, company string, relevance_score int, source string, website string, linkedin string")
    got = merge.best_company(d).collect()
    assert [(x.ord, x.website, x.linkedin) for x in got] == [(2, "w3", "l0")]
    old, new = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int"), spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, o int")
    assert sorted((x.k, x.v) for x in merge.upsert(old, new, "k", "o").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_ranking(spark):
    d = spark.createDataFrame([(i, h) for i, h in enumerate("aabbc")], "ord int, host string")
    assert [x.host for x in ranking.round_robin(d, F.col("host"), "ord").collect()] == list("abcab")
    q = spark.createDataFrame([(0, "site:x a", 9.0), (1, "b", 1.0), (2, "c", 2.0)], "ord int, query string, w double")
    assert [x.query for x in ranking.budgeted(q, "query", "w", "ord", 2).collect()] == ["c", "b"]
    assert [x.ord for x in ranking.page(q, 2, 2, F.col("ord")).collect()] == [2]
    a, b = (ranking.weighted_sample(q, "w", "ord", 2, 7).collect() for _ in range(2))
    assert a == b and len(a) == 2


def test_dedup(spark):
    d = spark.createDataFrame([(2, "A ", "X"), (1, "a", "x "), (3, "b", None), (4, "B", "")], "ord int, company_name string, website string")
    assert sorted(x.ord for x in dedup.by_name_and_website(d, "ord").collect()) == [1, 3]
    assert sorted(x.ord for x in dedup.keep_first(d, [F.lower(F.trim("company_name"))], [F.col("ord")], "dup").filter("dup").collect()) == [2, 4]
    one = spark.createDataFrame([(["A@x", " a@X ", "b", ""],)], "x array<string>")
    assert one.select(dedup.distinct_items(F.col("x")).alias("y")).first().y == ["A@x", "b"]


def test_lookup(spark):
    o = spark.createDataFrame([("ai", "concepts", "machine learning", 0), ("ai", "concepts", "deep learning", 1), ("cloud", "services", "cloud hosting service", 2), ("cloud", "services", "hosting", 3)], "domain string, channel string, term string, ordinal int")
    k = spark.createDataFrame([("AI",), ("hosting",), ("learning",), ("cloud hosting",), ("nothing",)], "keyword string")
    assert {x.keyword: x.domain for x in lookup.closest_domain(k, o).collect()} == {"AI": "ai", "hosting": "cloud", "learning": "ai", "cloud hosting": "cloud", "nothing": None}
    docs = spark.createDataFrame([(1, "Machine learning, machine  learning & hosting"), (2, None), (3, "x")], "id int, text string")
    assert sorted((x.id, x.term, x.hits) for x in lookup.term_hits(docs, "id", "text", o, "term").collect()) == [(1, "hosting", 1), (1, "machine learning", 2)]
    seen = spark.createDataFrame([("k", "t", "services", a, "2024-01-01") for a in (True, True, True, False)], "keyword string, term string, target_field string, accepted boolean, day string")
    learned = lookup.learned_terms(seen)
    assert learned.first().confidence == 0.75 and lookup.promoted(learned, o).count() == 5


def test_planner(spark):
    k = spark.createDataFrame([("erp software Pune",), ("chatbots",), ("Python  noida",)], "keyword string")
    got = planner.plan(k, "hybrid", 6).collect()
    mine = sorted([x for x in got if x.keyword.startswith("erp")], key=lambda x: x.priority)
    assert len(mine) == 6 and mine[0].query == "erp software Pune" and not any("site:" in x.query for x in mine)
    exact = {x.query: x.source for x in planner.plan(k, "exact", None).collect() if x.keyword == "chatbots"}
    assert len(exact) == 10 and exact["chatbots company"] == "google" and exact["site:clutch.co chatbots"] == "clutch"
    c = spark.createDataFrame([("crm", ["crm software", "lead tracking", "sales", "other"], ["hardware_development"])], "keyword string, c array<string>, d array<string>")
    semantic = [x.query for x in planner.plan(c, "semantic", None, "c", "d").orderBy("priority").collect()]
    assert semantic[:3] == ["crm", "crm software companies", "crm startups"] and "PCB design company" in semantic and "sales startups" in semantic and not any("other" in x for x in semantic)
    assert len(semantic) == len({x.lower() for x in semantic})


def test_variants(spark):
    cases = {
        "python": ["python", "python development company", "python software company", "python consulting firm"], "chatbots": ["chatbots", "chatbots companies", "chatbots startups", "chatbots solutions", "chatbots agency"],
        "data engineer": ["data engineer", "data engineering company", "data engineering consultancy", "big data company", "ETL consulting company"], "crm": ["crm", "crm company", "crm software company", "crm solutions provider", "crm vendor"],
        "seo": ["seo", "seo company", "seo agency", "seo firm"], "officer": ["officer", "officer company", "officer firm"], "bakery firm": ["bakery firm"], "": [],
    }
    d = spark.createDataFrame([(k,) for k in cases], "k string")
    assert {r.k: r.v for r in d.select("k", planner.variants(F.col("k")).alias("v")).collect()} == cases


def test_company_and_contact_queries(spark):
    d = spark.createDataFrame([("python", "Noida")], "keyword string, location string")
    b2b = [r.query for r in planner.company_queries(d).orderBy("place").collect()]
    assert len(b2b) == 20 and b2b[:4] == ["python Noida", "top python in Noida", "python Noida website", "python Noida pvt ltd"] and not any("site:" in q for q in b2b)
    every = [r.query for r in planner.company_queries(d, "b2c", 100).orderBy("place").collect()]
    assert every[0] == "python near Noida" and every[-1] == "site:sulekha.com python consulting firm Noida" and len(every) == 4 * 7
    q = spark.range(1).select(*[planner.contact_queries(F.lit("Acme"), F.lit(w), F.lit(lead), F.lit(c)).alias(n) for n, w, lead, c in (("all", False, False, False), ("web", True, True, False), ("none", False, False, True))]).first()
    assert len(q["all"]) == 6 and q.web == ['"Acme" "our team" OR "meet the team" OR "leadership"', '"Acme" "about us" founder CEO'] and q.none == []
    t = spark.createDataFrame([('site:clutch.co "crm" Pune',), ("best crm Pune",), ("crm Pune",), ("crm",)], "q string").select("q", planner.matching_template(F.col("q")).alias("t"))
    assert {r.q: r.t for r in t.collect()} == {'site:clutch.co "crm" Pune': 'site:clutch.co "{keyword}" {location}', "best crm Pune": "best {keyword} {location}", "crm Pune": "{keyword} {location}", "crm": None}


def test_health_numbers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(T.freshness(F.lit(a).cast("double"))) for a in (0, 60, 300, 1200, 2400, 7200, None)] == [1.0, 1.0, 0.8, 0.5, 0.2, 0.0, 0.0]
    assert one(T.aged(F.lit(100.0), F.lit(7))) == pytest.approx(100 * 0.995**7) and one(T.aged(F.lit(100.0), F.lit(None))) == 50
    assert one(T.beta_confidence(F.lit(8), F.lit(10))) == 0.75
    assert one(T.blended_confidence(F.lit(0.8), F.lit(50.0), F.lit(5))) == pytest.approx(0.65)
    assert [one(T.quarantine_seconds(F.lit(s))) for s in (0, 1, 2, 3, 99)] == [30, 60, 120, 300, 300]
    assert [one(T.tier(F.lit(g), F.lit(n), F.lit(n - g))) for g, n in ((0, 0), (15, 20), (10, 20), (2, 20))] == list("EABC")


def test_feedback(spark):
    log = spark.createDataFrame([("s", 0, "accepted_company", 0), ("s", 1, "zero_result", 0), ("t", 0, "zero_result", 0), ("t", 1, "search_hit", 25), ("t", 2, "captcha", 0)], "key string, ord int, outcome string, results int")
    got = {x.key: (x.score, x.queries_run, x.leads_found, x.failures) for x in T.feedback(log, "key", "ord", results="results").collect()}
    assert got == {"s": (4, 2, 1, 1), "t": (6, 3, 0, 2)}
    w = lambda *a: spark.range(1).select(T.feedback_weight(*[F.lit(x) for x in a]).alias("x")).first().x
    assert w(30, 0.0, None, None, None, None) == pytest.approx(0.001) and w(0, 0.0, None, None, None, None) == 1.0 and w(30, 100.0, None, None, None, None) == pytest.approx(1 - 0.999 * math.exp(-2))
    assert [w(3, 0.0, 10, s, f, 0.0) for s, f in ((100, 0), (-100, 0), (5, 0), (5, 50))] == pytest.approx([2.0, 0.2, 1.05, 0.001])
    r = T.source_ratings(T.feedback(log, "key", "ord", results="results"), "key").orderBy("key").collect()
    assert [(x.key, x.score, x.stars) for x in r] == [("s", 2.0, 4), ("t", 2.0, 4)]


def events(n=400):
    r = random.Random(4)
    return [(r.choice("abc"), i, float(i * r.choice([5, 90])), r.random() < 0.5) for i in range(n)]


def test_breaker_batch_equals_model(spark):
    rows = events() + [("d", i, float(i), True) for i in range(3)]
    got = {x.entity: (x.state, x.points, x.trips) for x in T.breaker_states(spark.createDataFrame(rows, "entity string, ord int, t double, failed boolean"), "entity", "ord", F.col("t"), F.col("failed")).collect()}
    for e in "abcd":
        s, p, _, trips = state.fold_breaker(("CLOSED", 0.0, 0.0, 0), [(t, f) for k, _, t, f in rows if k == e])
        assert got[e] == (s, p, trips)
    assert got["d"][0] == "OPEN"


def test_streams_equal_batch(spark, tmp_path):
    rows = events()
    schema = "entity string, ord int, t double, failed boolean"
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    d = spark.createDataFrame(rows, schema)
    got = {x.entity: (x.state, x.points, x.trips) for x in run(state.breaker(source()), "b1")}
    assert got == {x.entity: (x.state, x.points, x.trips) for x in T.breaker_states(d, "entity", "ord", F.col("t"), F.col("failed")).collect()}
    got = {x.entity: x.passed for x in run(state.bucket(source(), 0.02, 5.0), "b2")}
    assert got == {x.entity: x.passed for x in T.token_bucket(d, "entity", "ord", F.col("t"), 0.02, 5.0).collect()}
    got = {(x.entity, x.failed): x.events for x in run(state.counts(source(), ["entity", "failed"]), "b3")}
    assert got == {(x.entity, x.failed): x["count"] for x in d.groupBy("entity", "failed").count().collect()}


def test_stream_merge_and_frontier(spark, tmp_path):
    schema = "ord int, domain string, company_name string"
    for i, rows in enumerate([[(0, "a", None), (1, "b", "B")], [(2, "a", "A"), (3, "c", "C")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run_merge(batch, old):
        both = batch if old is None else old.withColumnRenamed("first_ord", "ord").drop("merged").unionByName(batch, allowMissingColumns=True)
        return merge.merge_by_key(both)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state.merge_batches(stream, str(tmp_path / "master"), run_merge, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((x.domain, x.company_name) for x in readers.master(spark, str(tmp_path / "master")).collect()) == [("a", "A"), ("b", "B"), ("c", "C")]
    pages = [("http://www.a.com/x?utm_source=q", "<b>t</b>"), ("https://a.com/x/", "t"), ("https://b.com", "u")]
    spark.createDataFrame([(*p, "2024-01-01 00:00:00") for p in pages], "url string, html string, at string").selectExpr("url", "html", "cast(at as timestamp) ts").write.parquet(str(tmp_path / "pages"))
    f = state.frontier(spark.readStream.schema("url string, html string, ts timestamp").parquet(str(tmp_path / "pages")), "ts")
    q = f.writeStream.format("memory").queryName("f1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(x.crawl_url for x in spark.table("f1").collect()) == ["https://a.com/x", "https://b.com"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"company_name": "A", "emails": ["x@y.z"], "other": 1}, {"company_name": "B"}]')
    (tmp_path / "b.json").write_text("{not json")
    good, bad = readers.json_records(spark, str(tmp_path / "*.json"))
    assert sorted(x.company_name for x in good.cache().collect()) == ["A", "B"] and all(x.source_file.endswith("a.json") for x in good.collect()) and len(bad.collect()) == 1
    assert readers.union_of_existing(spark, [str(tmp_path / "a.json"), str(tmp_path / "none.json")]).count() == 2
    assert readers.latest_file(spark, str(tmp_path)).endswith("b.json") and readers.latest_file(spark, str(tmp_path / "no")) is None
    body = '{"organic_results": [{"link": "https://a.com", "name": "A", "body": "' + "s" * 500 + '"}, {"title": "no url"}, {"url": "https://b.com"}]}'
    r = readers.search_results(spark.createDataFrame([("q", body), ("r", "[]"), ("s", "bad{")], "query string, body string")).orderBy("rank").collect()
    assert [(x.rank, x.url, x.title, len(x.snippet or "")) for x in r] == [(1, "https://a.com", "A", 400), (3, "https://b.com", None, 0)]
    d = spark.createDataFrame([(1, ["a"], {"k": "v"})], "i int, l array<string>, m map<string,string>")
    assert sinks.as_text_columns(d).first() == (1, '["a"]', '{"k":"v"}')
    assert readers.master(spark, str(tmp_path / "t")) is None
    sinks.write_snapshot(d, str(tmp_path / "t"))
    sinks.write_snapshot(readers.master(spark, str(tmp_path / "t")).union(d), str(tmp_path / "t"))
    assert readers.master(spark, str(tmp_path / "t")).count() == 2
    assert "i" in sinks.report("T", d.select("i"))
    with pytest.raises(ValueError):
        sinks.report("T", spark.range(300))


def log_rows(n=300, seed=5):
    r = random.Random(seed)
    return [(r.choice("abc"), i, float(i * 20), r.random() < (0.9 if i // 60 % 2 else 0.2), r.choice(["valid_results", "captcha", "timeout", "zero_results", "odd"])) for i in range(n)]


LOG = "e string, ord int, t double, failed boolean, outcome string"


def test_ratio_breaker_equals_model(spark):
    got = {x.e: (x.state, x.opens, x.backoff) for x in T.ratio_breaker(spark.createDataFrame(log_rows(), LOG), "e", "ord", F.col("t"), F.col("failed")).collect()}
    for e in "abc":
        until, probe, good, step, opens, last, t = 0.0, False, 0, 0, 0, [], 0.0
        for _, _, t, failed, _ in (x for x in log_rows() if x[0] == e):
            if t < until:
                continue
            if until > 0 and not probe:
                probe, good = True, 0
            if probe:
                if failed:
                    step, probe, opens = step + 1, False, opens + 1
                    until = t + (60, 120, 300, 600)[min(step, 3)]
                else:
                    good += 1
                    if good >= 2:
                        until, probe, good, step, last = 0.0, False, 0, 0, []
                continue
            last = (last + [failed])[-20:]
            if len(last) >= 6 and sum(last) / len(last) >= 0.8:
                until, opens = t + (60, 120, 300, 600)[min(step, 3)], opens + 1
        state = "PROBE" if probe else "OPEN" if until > t else "PROBE" if until > 0 else "CLOSED"
        assert got[e] == (state, opens, step) and opens > 0


@pytest.mark.parametrize("restart", [True, False])
def test_streak_breaker_equals_model(spark, restart):
    got = {x.e: (x.opens, x.skipped, x.streak) for x in T.streak_breaker(spark.createDataFrame(log_rows(), LOG), "e", "ord", F.col("t"), F.col("failed"), 3, 200.0, restart).collect()}
    for e in "abc":
        n, until, opens, skipped = 0, 0.0, 0, 0
        for _, _, t, failed, _ in (x for x in log_rows() if x[0] == e):
            if t < until:
                skipped += 1
                continue
            if restart and until > 0:
                n, until = 0, 0.0
            n = n + 1 if failed else 0
            if failed and n >= 3:
                until, opens = t + 200.0, opens + 1
        assert got[e] == (opens, skipped, n) and opens > 0


def test_score_and_throttle_folds(spark):
    d = spark.createDataFrame(log_rows(), LOG)
    steps = {"valid_results": 8, "captcha": -10, "timeout": -5, "zero_results": 0, "odd": -5}
    score = {x.e: x.score for x in T.score_fold(d, "e", "ord", F.col("outcome")).collect()}
    rate = {x.e: x.rate for x in T.throttle_fold(d, "e", "ord", F.when(F.col("outcome") == "captcha", 429), F.col("outcome") == "odd", F.when(F.col("failed"), 3.0).otherwise(0.5)).collect()}
    for e in "abc":
        s, r = 100.0, 1.0
        for _, _, _, failed, o in (x for x in log_rows() if x[0] == e):
            s = min(100.0, max(0.0, s + steps[o]))
            r = max(0.05, r * 0.4) if o == "captcha" else max(0.05, r * 0.5) if o == "odd" else max(0.1, r * 0.8) if failed else min(2.0, r * 1.1)
        assert score[e] == s and rate[e] == pytest.approx(r)
    snap = {x.e: x for x in T.snapshot(d, "e", "ord", "outcome", 5).collect()}
    mine = [x for x in log_rows() if x[0] == "a"]
    assert snap["a"]["last"] == [x[4] for x in mine[-5:]] and snap["a"].events == len(mine) and sum(snap["a"].by_outcome.values()) == len(mine)


def test_provider_scores_and_order(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.exploring_score(*[F.lit(x) for x in (0, 0, 0, 0, 0, 0.0, 0)])) == 100.0
    assert one(T.exploring_score(*[F.lit(x) for x in (4, 2, 1, 4, 0, 2.0, 0)])) == pytest.approx(0.35 * 50 + 0.2 * 25 + 0.1 * 100 + 0.25 * 84 + 0.1 * 100 + 7.5)
    assert one(T.balance_score(F.lit(True), F.lit(100.0), F.lit(10), F.lit(5), F.lit(2), F.lit(450.0), F.lit(False))) == pytest.approx(0.3 + 0.25 + 0.125 - 0.04 - 0.05)
    p = spark.createDataFrame([("a", 0, 10, 9, 0, True, "CLOSED"), ("b", 1, 10, 0, 0, True, "CLOSED"), ("c", 2, 0, 0, 0, True, "OPEN"), ("d", 3, 10, 5, 1, True, "CLOSED")], "provider string, position int, queries int, failures int, cost int, healthy boolean, breaker string")
    order = ranking.provider_order(p).orderBy("place").collect()
    assert [x.provider for x in order] == ["b", "d", "a", "c"]
    runs = ranking.provider_order(p).join(p.select("provider", "cost"), "provider").crossJoin(spark.range(400).withColumnRenamed("id", "run")).select("run", "provider", "place", "cost")
    first = ranking.explored(runs, "run").filter("place = 1").groupBy("provider").count().collect()
    assert {x.provider: x["count"] for x in first}["b"] > 300 and len(first) == 3
    q = spark.createDataFrame([("x", 1, 0, 5.0, 1, "p"), ("y", 2, 1, 4.0, 2, "q"), ("z", 2, 0, 6.0, 3, "p")], "id string, priority int, depth int, ts double, seq int, provider string")
    assert [x.id for x in ranking.priority_queue(q).collect()] == ["z", "y", "x"]
    assert [x.id for x in ranking.priority_queue(q, spark.createDataFrame([("q", 9)], "provider string, priority int")).collect()] == ["y", "z", "x"]


def test_parsers_and_distributions(spark):
    d = spark.createDataFrame([("css", True, 10.0), ("css", False, 99.0), ("json", True, 4.0), ("json", True, 6.0), ("any", False, 1.0)], "parser string, ok boolean, ms double")
    rep = T.parser_report(d, "parser", F.col("ok"), "ms")
    assert {x.parser: (x.successes, x.failures, x.success_rate, x.avg_time_ms) for x in rep.collect()} == {"css": (1, 1, 0.5, 10.0), "json": (2, 0, 1.0, 5.0), "any": (0, 1, 0.0, 0.0)}
    b = T.best_and_worst_parser(rep, "parser").first()
    assert (b.best, b.worst, b.avg_parse_ms) == ("json", "any", pytest.approx(20 / 3))
    t = spark.createDataFrame([('site:clutch.co "a" b', "accepted_company"), ('site:clutch.co "c" d', "zero_result"), ("best a b", "zero_result"), ("x", "zero_result")], "query string, outcome string")
    assert [(x.template, x.runs, x.leads, x.roi) for x in T.template_report(t, planner.matching_template(F.col("query"))).collect()] == [('site:clutch.co "{keyword}" {location}', 2, 1, 0.5), ("best {keyword} {location}", 1, 0, 0.0)]
    leads = spark.createDataFrame([("High", 80, {"linkedin": ("found_on_site",)}), ("Low", 20, {"linkedin": ("slug_guess",)}), ("Low", 30, {}), ("Medium", 50, None)], "lead_quality string, confidence_score int, social map<string,struct<source:string>>")
    assert stages.quality_distribution(leads).first().asDict() == {"total": 4, "high": 1, "medium": 1, "low": 2, "avg_confidence": 45.0}
    assert stages.social_counts(leads).first().asDict() == {"rows": 4, "found": 1, "guessed": 1, "with_any": 2}
    w = spark.createDataFrame([('["a"]', 1), ("bad", 2), (None, 3)], "j string, _flags int")
    assert [x.v for x in stages.without_debug(w.withColumn("v", stages.json_or(F.col("j"), "array<string>", F.array().cast("array<string>")))).collect()] == [["a"], [], []]


def test_resolved_intent(spark):
    o = spark.createDataFrame([("cloud", "concepts", "Kubernetes", 0), ("cloud", "services", "Cloud Hosting", 1), ("ai", "concepts", "Deep Learning", 2), ("ai", "positions", "ML Engineer", 3)], "domain string, channel string, term string, ordinal int")
    k = spark.createDataFrame([("cloud",), ("deep learning hosting",), ("quilts",)], "keyword string")
    got = {x.keyword: x for x in lookup.resolved_intent(k, o).collect()}
    assert (got["cloud"].primary_domain, got["cloud"].confidence, got["cloud"].services) == ("Cloud", 1.0, ["Cloud Hosting"])
    assert got["deep learning hosting"].primary_domain == "Ai + Cloud" and got["deep learning hosting"].confidence == 0.7 and got["deep learning hosting"].concepts == ["Deep Learning", "Kubernetes"]
    assert (got["quilts"].primary_domain, got["quilts"].confidence) == ("Quilts", 0.4) and "Quilts Services" in got["quilts"].services
    docs = spark.createDataFrame([(1, "Deep learning and kubernetes, kubernetes"), (2, "nothing")], "id int, text string")
    assert {x.id: x.industry for x in lookup.ontology_industry(docs, "id", "text", o).collect()} == {1: "Cloud", 2: "Unknown"}


def test_probe_tables_take_the_last_row(spark):
    d = spark.createDataFrame([("Acme", "https://acme.com", ["a@acme.com"], ["+1 212 555 0199"])], "company_name string, website string, emails array<string>, phones array<string>")
    mx = spark.createDataFrame([("acme.com", False, "old", 1), ("acme.com", True, "ok", 2)], "domain string, has_mx boolean, reason string, ord int")
    sites = spark.createDataFrame([("https://acme.com", 500, "x"), ("https://acme.com", 200, "x")], "url string, status int, reason string")
    r = stages.verify(d, mx, sites).kept.first()
    assert r.verified_emails == ["a@acme.com"] and r.email_notes == {"a@acme.com": "ok"} and r.website_reachable is False
    kept, rejects = stages.chain(spark.createDataFrame([(1, "Acme", "https://acme.com", ["a@acme.com"], [], None)], "ord int, company_name string, website string, emails array<string>, phones array<string>, people array<struct<name:string,designation:string>>"), stages.clean, stages.finalize)
    assert kept.count() == 1 and len(rejects) == 2


def test_crawl_budget(spark):
    from leadweave.streaming import state

    d = spark.createDataFrame([(i, f"https://a.com/{i % 20}") for i in range(40)] + [(99, "https://b.com/")], "ord long, url string")
    got = state.crawl_budget(d, "ord").collect()
    assert sorted(x.ord for x in got) == [*range(15), 99]
