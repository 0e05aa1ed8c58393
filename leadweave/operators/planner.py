"""Search tasks and queries from keywords: templates, places, variants and a budget.

Tasks are made row by row (arrays of templates), so a keyword's plan needs no join; only the
choice of the first so many of each keyword is a ranked group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions import classify as C
from leadweave.functions import names as N
from leadweave.functions import values as V
from leadweave.operators.dedup import keep_first
from leadweave.operators.ranking import per_group

TASKS = "array<struct<source:string,query:string>>"


def _fill(template: str, **parts: Column) -> Column:
    """A template's text with columns for its names in braces."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), parts[name]]
    return F.concat(*out, F.lit(rest))


def _filled(templates: Iterable[str], **parts: Column) -> Column:
    return F.array(*[_fill(t, **parts) for t in templates])


def expanded(keyword: Column) -> Column:
    """Company searches that a keyword stands for, by its intent; never empty."""
    low = F.lower(F.trim(keyword))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    intent = C.keyword_intent(keyword)
    listed = lambda xs: F.array(*map(F.lit, xs))
    core = F.array_join(F.filter(words, lambda w: ~w.isin(*V.ROLE_WORDS)), " ")
    role = F.when(core != "", _filled(V.ROLE_TEMPLATES, keyword=core)).otherwise(_filled(("{keyword} company", "{keyword} firm"), keyword=keyword))
    for k, xs in reversed(V.ROLE_EXPANSIONS.items()):
        role = F.when(low.contains(k), listed(xs)).otherwise(role)
    tech = _filled(V.TECHNOLOGY_TEMPLATES, keyword=low)
    for k, xs in reversed(V.TECHNOLOGY_EXPANSIONS.items()):
        tech = F.when((low == k) | F.array_contains(words, k), listed(xs)).otherwise(tech)
    plain = low
    for w in ("companies", "company", "firm", "firms"):
        plain = F.replace(plain, F.lit(w), F.lit(""))
    plain = F.trim(plain)
    rest = F.when(intent == "company", F.array(keyword)).when(plain != "", _filled(V.INDUSTRY_TEMPLATES, keyword=plain)).otherwise(F.array(keyword))
    for k, xs in reversed(V.INDUSTRY_EXPANSIONS.items()):
        rest = F.when(F.array_contains(words, k), listed(xs)).otherwise(rest)
    return (
        F.when(intent == "job_role", role).when(intent == "technology", tech).when(intent == "product", _filled(V.PRODUCT_TEMPLATES, keyword=keyword))
        .when(intent == "service", _filled(V.SERVICE_TEMPLATES, keyword=keyword)).otherwise(rest)
    )


def variants(keyword: Column, n: int = 5) -> Column:
    """The keyword and its expansions, near-equal ones once, at most n."""
    raw = F.trim(F.coalesce(keyword, F.lit("")))

    def cleaned(x: Column) -> Column:
        for a, b in ((r"(?i)\bcompany\s+company\b", "company"), (r"(?i)\bcompanies\s+company\b", "companies"), (r"(?i)\bfirm\s+firm\b", "firm"), (r"(?i)\bstartup\s+startup\b", "startup")):
            x = F.regexp_replace(x, a, b)
        return F.trim(x)

    every = F.filter(F.transform(F.concat(F.array(raw), expanded(raw)), cleaned), lambda x: x != "")

    def once(xs: Column) -> Column:
        keys = F.transform(xs, N.query_key)
        return F.slice(F.filter(xs, lambda x, i: F.array_position(keys, N.query_key(x)) == i + 1), 1, n)

    return F.when(raw == "", F.array().cast("array<string>")).otherwise(F.transform(F.array(every), once)[0])


def base_weight(query: Column) -> Column:
    q = F.lower(query)
    return F.when(q.contains("site:"), V.QUERY_WEIGHTS["source"]).when(q.startswith('"'), V.QUERY_WEIGHTS["quoted"]).otherwise(V.QUERY_WEIGHTS["generic"])


def _tasks(templates, sources: bool = True, **parts: Column) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("source"), _fill(t, **parts).alias("query")) for s, t in templates]).cast(TASKS)


def planned(keyword: Column, mode: str, concepts: Column | None = None, domains: Column | None = None) -> Column:
    """Tasks of a keyword in order (array of source and query, not yet distinct).

    mode: exact, semantic or hybrid (both). concepts: ranked concepts of the keyword's domains
    (an array; default none); domains: their names, for the tasks of special ones.
    """
    k, place = N.without_location(keyword)
    loc = F.when(place == "", F.lit("")).otherwise(F.concat(F.lit(" "), place))
    exact = _tasks(V.EXACT_TASKS, k=k, l=loc)
    if mode == "exact":
        return exact
    none = F.array().cast("array<string>")
    given = none if concepts is None else F.coalesce(concepts, none)
    words = F.array_distinct(F.split(k, r"\s+"))

    def relevant(c: Column, i: Column) -> Column:
        low = F.lower(c)
        share = F.size(F.array_intersect(words, F.array_distinct(F.split(low, r"\s+")))) / F.size(words)
        return (share >= 0.35) | F.contains(k, low) | F.contains(low, k) | (i < 3)

    kept = F.array_distinct(F.filter(given, relevant))
    ranked = F.when(F.array_contains(kept, k), kept).otherwise(F.concat(F.array(k), kept))
    focus = F.get(ranked, F.lit(0))
    of = lambda templates, c: _tasks(templates, c=c, l=loc)
    by_concept = F.flatten(F.transform(ranked, lambda c: of(V.CONCEPT_TASKS, c)))
    profiles = F.flatten(F.transform(F.slice(ranked, 1, 2), lambda c: of(V.PROFILE_TASKS, c)))
    special = F.array().cast(TASKS)
    if domains is not None:
        special = F.when(F.array_contains(domains, V.HARDWARE_DOMAIN), _tasks([(s, t) for s in V.HARDWARE_SOURCES for t in V.HARDWARE_TASKS], l=loc)).otherwise(special)
    raw = F.array(F.struct(F.lit("google").alias("source"), keyword.alias("query"))).cast(TASKS)
    placed = F.when(place != "", F.array(F.struct(F.lit("google").alias("source"), F.concat(k, loc).alias("query"))).cast(TASKS)).otherwise(F.array().cast(TASKS))
    semantic = F.concat(by_concept, special, of(V.FOCUS_TASKS, focus), profiles)
    return F.concat(placed, raw, exact, semantic) if mode == "hybrid" else F.concat(placed, raw, semantic)


def plan(keywords: DataFrame, mode: str = "semantic", budget: int | None = 20, concepts: str | None = None, domains: str | None = None) -> DataFrame:
    """keyword, source, query, priority: distinct tasks of each keyword, the raw keyword first;
    with a budget, general queries before site searches, at most so many.

    The raw keyword and the one with its place come first but are made last: where another
    task has the same text, that one stays.
    """
    col = lambda c: F.col(c) if c else None
    d = keywords.select("keyword", F.posexplode(planned(F.col("keyword"), mode, col(concepts), col(domains))).alias("ord", "t"))
    d = d.select("keyword", "ord", "t.source", F.trim(F.regexp_replace("t.query", r"\s+", " ")).alias("query")).filter("query <> ''")
    own = F.lower("query") == F.lower(F.trim(F.regexp_replace("keyword", r"\s+", " ")))
    late = (F.col("ord") < 2) & (own if mode != "exact" else F.lit(False))
    d = keep_first(d, [F.col("keyword"), F.lower("query")], [late.cast("int"), F.col("ord")])
    d = d.withColumn("site", F.lower("query").contains("site:").cast("int"))
    order = [F.col("site"), F.col("ord")] if budget else [F.col("ord")]
    d = per_group(d, ["keyword"], budget or 1 << 30, *order, name="priority")
    return d.select("keyword", "source", "query", F.col("priority").cast("int"))


def company_queries(keywords: DataFrame, lead_type: str = "b2b", most: int = 20) -> DataFrame:
    """keyword, location, query, place: search queries for companies of an industry at a location,
    by weight, then in the order of their making; at most so many."""
    bare = lambda c: F.regexp_replace(F.trim(F.coalesce(F.col(c), F.lit(""))), "^['\"]+|['\"]+$", "")
    loc = bare("location")

    def made(v: Column) -> Column:
        each = lambda templates, **more: F.flatten(F.transform(v, lambda x: _filled(templates, v=x, l=loc, **more)))
        if lead_type == "b2c":
            return each((*V.B2C_QUERIES, *[f"{s} {{v}} {{l}}" for s in V.B2C_SOURCES]))
        return F.concat(each(V.B2B_QUERIES), *[each(V.B2B_SOURCE_QUERIES, s=F.lit(s)) for s in V.B2B_SOURCES], each(V.B2B_LAST))

    every = F.transform(F.array(variants(bare("keyword"))), made)[0]
    d = keywords.select("keyword", "location", F.posexplode(F.array_distinct(F.transform(every, lambda q: F.trim(q)))).alias("ord", "query")).filter("query <> ''")
    d = per_group(d, ["keyword", "location"], most, F.desc(base_weight(F.col("query"))), F.col("ord"), name="place")
    return d.select("keyword", "location", "query", F.col("place").cast("int"))


def contact_queries(company: Column, has_website: Column, has_leadership: Column, has_contact: Column) -> Column:
    """Queries for a company's contacts that are not known yet; none if a contact is."""
    q = lambda text: F.array(_fill(text, c=company))
    none = F.array().cast("array<string>")
    lead = F.concat(q('site:linkedin.com/in "{c}" founder OR CEO OR director'), q('site:linkedin.com/in "{c}" "co-founder"'), q('"{c}" site:linkedin.com'))
    team = F.concat(q('"{c}" "our team" OR "meet the team" OR "leadership"'), q('"{c}" "about us" founder CEO'))
    out = F.concat(F.when(has_leadership, none).otherwise(lead), team, F.when(has_website, none).otherwise(q('"{c}" contact email phone')))
    return F.when(has_contact, none).otherwise(out)


def matching_template(query: Column) -> Column:
    """The search template that a query was made from, or null: of those whose text fits, with
    anything for their names, the one with the longest fixed text (then the first)."""
    import re

    q, found = F.lower(F.trim(query)), F.lit(None).cast("string")
    every = [t for _, _, templates in V.SOURCE_TEMPLATES for t in templates]
    fixed = lambda t: len(re.sub(r"\{\w+\}", "", t))
    for t in sorted(reversed(every), key=fixed):
        pattern = "^" + ".+".join(re.escape(part) for part in re.split(r"\{\w+\}", t)) + "$"
        found = F.when(q.rlike(pattern), F.lit(t)).otherwise(found)
    return found
