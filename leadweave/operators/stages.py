"""Record stages: clean, verify, enrich, finalize, polish. Each returns kept rows, rejects
with a reason, and metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions import classify as C
from leadweave.functions import contact as E
from leadweave.functions import names as N
from leadweave.functions import url as U
from leadweave.functions import values as V
from leadweave.operators.dedup import by_name_and_website, distinct_items, distinct_people
from leadweave.operators.merge import merge_by_key
from leadweave.schemas import MASTER

STRINGS = "array<string>"


@dataclass
class StageResult:
    kept: DataFrame
    rejects: DataFrame
    metrics: DataFrame


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(STRINGS))


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _flag(tag: str, when: Column) -> Column:
    return F.when(when, F.array(F.lit(tag))).otherwise(F.array().cast(STRINGS))


def _tally(df: DataFrame, **counts: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()])


def flag_tally(df: DataFrame, flags: str = "flags") -> DataFrame:
    """How often each flag occurs; `tag:detail` counts as its tag."""
    tags = df.select(F.explode(flags).alias("f")).select(F.substring_index("f", ":", 1).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def clean(leads: DataFrame, order: str = "ord") -> StageResult:
    """Deduplicates, cleans contact fields and flags what is wrong; flagged rows are rejects."""
    total = leads.agg(F.count(F.lit(1)).alias("raw"))
    d = by_name_and_website(leads, order)
    bad = lambda s: F.transform(F.filter(_list("emails"), lambda e: E.email_status(e) == s), lambda e: F.concat(F.lit(f"email_{s}:"), e))
    named = lambda p: (F.trim(F.coalesce(p["name"], F.lit(""))) != "") & ~E.is_product_label(p["name"])
    people = F.filter("people", named)
    lost = F.size(F.col("people")) - F.size(people)
    d = d.withColumn("flags", F.concat(
        _flag("directory_or_article_page", C.is_listing(F.col("company_name"))), bad("junk"), bad("malformed"),
        F.transform(F.filter(_list("phones"), lambda p: ~E.has_seven_digits(p)), lambda p: F.concat(F.lit("phone_malformed:"), p)),
        F.when(F.coalesce(lost, F.lit(0)) > 0, F.array(F.concat(F.lit("people_dropped:"), lost.cast("string")))).otherwise(F.array().cast(STRINGS)),
    ))
    ok = F.transform(F.filter(_list("emails"), lambda e: E.email_status(e) == "ok"), E.unescaped_email)
    d = d.withColumns({"emails": ok, "phones": F.filter(_list("phones"), E.has_seven_digits), "people": people})
    name = F.trim(F.coalesce(F.col("company_name"), F.lit("")))
    sparse = _empty("website") & (F.size("emails") == 0) & (F.size("phones") == 0) & ((F.length(name) < 2) | C.is_listing(name))
    d = d.withColumn("flags", F.concat("flags", _flag("sparse_no_contact_channel", sparse)))
    fine = F.size("flags") == 0
    m = total.crossJoin(_tally(d, clean=fine, flagged=~fine)).withColumn("duplicates", F.col("raw") - F.col("rows"))  # one row beside one row
    return StageResult(d.filter(fine), d.filter(~fine), m)


def rescue(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flagged rows that are companies after all, and pages that are listings."""
    listing = F.array_contains("flags", "directory_or_article_page")
    return flagged.filter(~listing), flagged.filter(listing)


def _probe(table: DataFrame, key: str) -> DataFrame:
    """One row of each key: the last by the column ord, where the table has one, then by content."""
    row = F.struct(*[c for c in table.columns if c != key])
    order = F.struct(*(["ord"] if "ord" in table.columns else []), F.to_json(row).alias("_j"))
    return table.groupBy(key).agg(F.max_by(row, order).alias("_r")).select(key, "_r.*")


def verify(leads: DataFrame, mx: DataFrame, sites: DataFrame) -> StageResult:
    """Joins pre-fetched probes: mx(domain, has_mx, reason), site(url, status, reason); the last
    row of a key counts (column ord)."""
    d = leads.withColumn("_id", F.sha2(F.to_json(F.struct("company_name", "website", "emails", "phones")), 256))
    asked = d.select("_id", F.explode("emails").alias("e")).distinct().withColumn("domain", U.address_domain(F.col("e")))
    found = asked.join(_probe(mx, "domain"), "domain", "left").groupBy("_id").agg(
        F.array_sort(F.collect_set(F.when(F.coalesce("has_mx", F.lit(False)), F.col("e")))).alias("verified_emails"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("e", F.coalesce("reason", F.lit("not_probed")).alias("reason"))))).alias("email_notes"),
    )
    d = d.join(found, "_id", "left")
    site = _probe(sites, "url").select(F.col("url").alias("website"), F.col("status"))
    d = d.join(site, "website", "left")
    d = d.withColumns({
        "verified_emails": _list("verified_emails"), "verified_phones": F.filter(_list("phones"), E.is_phone),
        "website_reachable": F.when(_empty("website"), F.lit(None).cast("boolean")).otherwise(F.coalesce(F.col("status").between(200, 399), F.lit(False))),
    })
    passed = (F.size("verified_emails") > 0) | (F.size("verified_phones") > 0) | ~_empty("website") | (F.length(F.trim(F.coalesce("company_name", F.lit("")))) >= 2)
    d = d.withColumn("verification_passed", passed).drop("_id", "status")
    return StageResult(d.filter("verification_passed"), d.filter("NOT verification_passed"), _tally(d, passed=F.col("verification_passed")))


def enrich(leads: DataFrame, registry: DataFrame, whois: DataFrame) -> DataFrame:
    """Registry and WHOIS tables joined on; the last row of a name or domain counts (column ord)."""
    last = registry.groupBy("company_name").agg(F.max_by(F.struct("matched", "reason", "registered_name"), "ord").alias("r"))
    default = F.struct(F.lit(False).alias("matched"), F.lit("not_processed").alias("reason"), F.lit(None).cast("string").alias("registered_name"))
    d = leads.join(last, "company_name", "left").withColumn("corporate_registry", F.coalesce("r", default)).drop("r")
    w = _probe(whois, "domain").select(F.col("domain").alias("_d"), F.struct("registrar", "creation_date", "org", "country").alias("whois"))
    return d.join(w, U.lead_domain(F.col("website")) == F.col("_d"), "left").drop("_d")


def domain_candidates(name: Column) -> Column:
    """Hosts a company of this name may use (nothing is probed)."""
    s = N.slug(name)
    return F.when(s == "", F.array().cast(STRINGS)).otherwise(F.array(*[F.concat(s, F.lit(t)) for t in V.CANDIDATE_SUFFIXES]))


def is_registry_candidate(name: Column) -> Column:
    return (F.trim(name) != "") & ~name.contains("?") & (F.size(F.split(F.trim(name), r"\s+")) <= 6)


def finalize(leads: DataFrame, order: str = "ord") -> StageResult:
    """Promotes discovered values, drops articles and rows without a channel, then internal
    columns (those with a leading underscore), and deduplicates again."""
    d = leads
    have = set(d.columns)
    if "discovered_website" in have:
        d = d.withColumn("website", F.coalesce(F.nullif("website", F.lit("")), "discovered_website"))
    if "verified_emails" in have:
        more = _list("discovered_emails") if "discovered_emails" in have else F.array().cast(STRINGS)
        d = d.withColumn("emails", F.array_sort(F.array_union(_list("verified_emails"), more)))
    reach = F.coalesce(F.col("website_reachable"), F.lit(False)) if "website_reachable" in have else ~_empty("website")
    channel = (F.size(_list("emails")) > 0) | (F.size(_list("phones")) > 0) | reach
    reason = F.when(C.is_article(F.col("company_name"), F.col("website")), F.lit("article_or_directory_page")).when(~channel, F.lit("no_verified_channel"))
    d = d.withColumn("drop_reason", reason)
    kept = by_name_and_website(d.filter("drop_reason IS NULL"), order)
    kept = kept.select([c for c in kept.columns if not c.startswith("_") and c != "drop_reason"])
    return StageResult(kept, d.filter("drop_reason IS NOT NULL"), _tally(d, dropped=F.col("drop_reason").isNotNull()))


def own_emails(emails: Column, website: Column) -> Column:
    """Addresses of the own domain where there are some; none of a list that spans more than
    four foreign domains (scraped from a footer)."""
    own = U.address_domain(website)
    domains = F.array_distinct(F.transform(emails, U.address_domain))
    mine = F.filter(emails, lambda e: U.address_domain(e) == own)
    return F.when((F.size(domains) > 4) & ~F.coalesce(F.array_contains(domains, own), F.lit(False)), F.array().cast(STRINGS)).when(F.size(mine) > 0, mine).otherwise(emails)


def polish(leads: DataFrame) -> StageResult:
    d = leads.withColumns({"phones": distinct_items(_list("phones")), "emails": own_emails(distinct_items(_list("emails")), F.coalesce("website", F.lit(""))), "people": F.filter(distinct_people(F.col("people")), lambda p: ~E.is_garbage_name(F.coalesce(p["name"], F.lit(""))))})
    nothing = (F.size("emails") == 0) & (F.size("phones") == 0) & (F.coalesce(F.size("people"), F.lit(0)) <= 0) & _empty("linkedin")
    d = d.withColumn("drop_reason", F.when(C.is_polish_article(F.col("company_name"), F.col("website")), F.lit("article_or_directory_page")).when(nothing, F.lit("nothing_usable_after_polish")))
    return StageResult(d.filter("drop_reason IS NULL").drop("drop_reason"), d.filter("drop_reason IS NOT NULL"), _tally(d, dropped=F.col("drop_reason").isNotNull()))


def to_master(leads: DataFrame, history: DataFrame | None = None, order: str = "ord") -> StageResult:
    """Fixed types, rejects by the schema's rules, then the merge by domain over history and batch."""
    reason = F.when(F.length(F.coalesce("company_name", F.lit(""))) < 1, F.lit("company_name")).when(F.col("website").isNull(), F.lit("website"))
    d = leads.withColumn("reject_reason", reason)
    good = d.filter("reject_reason IS NULL").withColumns({"domain": U.lead_domain(F.col("website")), "industry": N.industry(F.col("industry")), "emails": E.merge_emails(_list("emails")), "phones": E.merge_phones(_list("phones"))})
    batch = good.select(*[c for c in MASTER if c in good.columns], order)
    if history is not None:
        base = batch.agg(F.min(order)).first()[0] or 0
        top = history.agg(F.max("first_ord")).first()[0] or 0
        batch = history.select(*[c for c in MASTER if c in history.columns], (F.col("first_ord") - F.lit(top + 1 - base)).alias(order)).unionByName(batch, allowMissingColumns=True)
    no_domain = good.filter("domain = ''").withColumn("reject_reason", F.lit("no_domain"))
    rejects = d.filter("reject_reason IS NOT NULL").unionByName(no_domain, allowMissingColumns=True)
    return StageResult(merge_by_key(batch, "domain", order), rejects, _tally(d, invalid=F.col("reject_reason").isNotNull()))


def lookup(master: DataFrame, domain: str | None = None, industry: str | None = None) -> DataFrame:
    """Exact lookup; the predicates reach the Parquet scan."""
    if domain is not None:
        master = master.filter(F.col("domain") == domain.lower())
    return master if industry is None else master.filter(F.col("industry") == (industry.upper() if len(industry) <= 3 else industry.title()))


def coverage(leads: DataFrame) -> DataFrame:
    """Rows, and per cent with e-mails and phones to one decimal (half even); 0 for no rows."""
    share = lambda c: F.coalesce(F.bround(100 * F.count_if(F.size(_list(c)) > 0) / F.nullif(F.count(F.lit(1)), F.lit(0)), 1), F.lit(0.0))
    return leads.agg(F.count(F.lit(1)).alias("total"), share("emails").alias("pct_email"), share("phones").alias("pct_phone"))


def without_debug(df: DataFrame, *more: str) -> DataFrame:
    """Without the columns that only help to find faults."""
    return df.drop(*V.DEBUG_FIELDS, *more)


def json_or(text: Column, kind: str, default: Column) -> Column:
    """JSON text as a value of a type; the default for null or broken text."""
    return F.coalesce(F.from_json(text, kind), default)


def card(company: str = "c", page: str = "p") -> Column:
    """Lead card from a discovered company and what its pages gave (both structs)."""
    c, p = (lambda n: F.col(f"{company}.{n}")), (lambda n: F.col(f"{page}.{n}"))
    known = lambda x: F.nullif(F.nullif(x, F.lit("")), F.lit("Unknown"))
    score = F.coalesce(c("relevance_score"), p("completeness"))
    return F.struct(
        c("company").alias("company_name"), p("website").alias("website"), c("linkedin").alias("linkedin"), F.coalesce(known(p("industry_detected")), known(c("industry_detected")), c("industry")).alias("industry"), c("location").alias("location"),
        p("contact_page").alias("contact_page"), p("about_page").alias("about_page"), p("team_page").alias("team_page"), p("emails").alias("emails"), p("phones").alias("phones"), p("social_links").alias("social_links"), p("people").alias("people"), c("source").alias("source"),
        score.alias("confidence_score"), C.quality_label(score).alias("lead_quality"), F.coalesce(p("company_type"), F.lit("Unknown")).alias("company_type"), F.coalesce(c("relevance_score"), F.lit(0)).alias("relevance_score"), F.coalesce(c("relevance_tier"), F.lit("LOW")).alias("relevance_tier"),
    )


def quality_distribution(leads: DataFrame) -> DataFrame:
    """Leads by quality, and their mean confidence; 0 without leads."""
    kinds = [F.count_if(F.col("lead_quality") == k).alias(k.lower()) for k in ("High", "Medium", "Low")]
    return leads.agg(F.count(F.lit(1)).alias("total"), *kinds, F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence"))


def social_counts(leads: DataFrame, links: str = "social") -> DataFrame:
    """Rows, those whose profile link was found or guessed, and those with any link. links: a
    map of network to struct(source)."""
    source = F.try_element_at(F.col(links), F.lit("linkedin"))["source"]
    return leads.agg(F.count(F.lit(1)).alias("rows"), F.count_if(source == "found_on_site").alias("found"), F.count_if(source == "slug_guess").alias("guessed"), F.count_if(F.coalesce(F.size(F.col(links)), F.lit(0)) > 0).alias("with_any"))


def chain(leads: DataFrame, *steps) -> tuple[DataFrame, list[DataFrame]]:
    """Runs stages one after the other (DataFrame to StageResult or to DataFrame): what all of them
    kept, and the rejects of each that has some."""
    rejects = []
    for step in steps:
        out = step(leads)
        if isinstance(out, StageResult):
            rejects.append(out.rejects)
            out = out.kept
        leads = out
    return leads, rejects
