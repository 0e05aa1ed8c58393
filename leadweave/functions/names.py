"""Company names, titles and other short texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave.functions import url as U
from leadweave.functions import values as V

#: Words that end a company's name without being part of it.
LEGAL = ("inc", "incorporated", "ltd", "limited", "llc", "corp", "corporation", "co", "plc", "pvt", "gmbh", "ag", "sa", "bv")
PLACES = ("india", "india pvt", "international", "global", "worldwide", "americas", "america", "europe", "european", "asia", "asian", "apac")


def _tail(words: tuple[str, ...]) -> str:
    return r"(?i)(?:(?:^|\s+)(?:" + "|".join(words) + r")\.?)+$"


def _without_tail(words: tuple[str, ...]) -> Callable[[Column], Column]:
    """Takes such words off a text's end; only a text whose last word is one is searched."""
    last = sorted({w.split()[-1] for w in words})
    return lambda t: F.when(F.lower(F.substring_index(t, " ", -1)).isin(*last), F.regexp_replace(t, _tail(words), "")).otherwise(t)


def company_name(name: Column) -> Column:
    """Name without punctuation and without legal, place and again legal words at its end.
    If nothing would be left, the cleaned name. Known brands in their own spelling."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s\-]", "")), r"\s+", " ")
    brands = {k: brand for token, brand in V.NAME_OVERRIDES.items() for k in (token, brand.lower())}

    def short(c: Column) -> Column:
        out = c
        for words in (LEGAL, PLACES, LEGAL):
            out = U.bound(out, _without_tail(words))
        return F.struct(c.alias("clean"), out.alias("out"))

    def named(n: Column) -> Column:
        return U.looked_up(brands, F.lower(n["out"]), F.when(n["out"] == "", n["clean"]).otherwise(n["out"]))

    return U.bound(U.bound(clean, short), named)


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(company_name(name)), "[^a-z0-9]", "")


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first (not initcap: "o'neil" becomes "O'Neil")."""
    parts = F.regexp_extract_all(text, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def industry(text: Column) -> Column:
    return F.when(F.length(text) <= 3, F.upper(text)).otherwise(title_case(text))


def slug(name: Column, joiner: str = "") -> Column:
    """Letters and digits of a name; without a joiner, without the words that most names share."""
    s = F.lower(F.trim(name))
    if joiner == "-":
        return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.regexp_replace(s, r"\b(?:" + "|".join(V.CANDIDATE_STOP) + r")\b", ""), "[^a-z0-9]", joiner)


def tidy(text: Column) -> Column:
    """White space collapsed, punctuation at the edges gone."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"^[ \-|:.,]+|[ \-|:.,]+$", "")


def title_parts(title: Column) -> Column:
    """Parts of a result's title between separators with blanks around them, or after a colon."""
    parts = F.split(tidy(title), r"\s+\|\s+|\s+[-–]\s+|\s+:\s+|:\s+")
    return F.filter(F.transform(parts, tidy), lambda x: x != "")


def without_repeats(text: Column) -> Column:
    """Words without those that repeat the word before (letter case aside)."""
    words = F.split(F.trim(text), r"\s+")
    return F.array_join(F.filter(words, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.coalesce(F.get(words, i - 1), F.lit(""))))), " ")


def concept(text: Column) -> Column:
    """A concept's label: a known one, whatever its version; else the text in title case."""
    low = F.regexp_replace(F.lower(F.trim(text)), r"\s*v[0-9]+(?:\.[0-9]+)*$", "")
    return U.looked_up(V.CONCEPTS, low, title_case(F.trim(text)))


def query_key(query: Column) -> Column:
    """Key under which near-equal queries meet: company words in the singular, no plural s."""
    q = F.replace(F.replace(F.lower(F.trim(query)), F.lit("companies"), F.lit("company")), F.lit("firms"), F.lit("firm"))
    return F.when(q.endswith("s") & ~q.endswith("ss"), F.substring(q, F.lit(1), F.length(q) - 1)).otherwise(q)


def is_sentence(text: Column) -> Column:
    """More a phrase than a name: by its start, a question mark, or an informational term."""
    low, out = F.lower(text), text.contains("?")
    for s in V.SENTENCE_STARTS:
        out = out | low.startswith(s)
    for s in V.SENTENCE_TERMS:
        out = out | low.contains(s)
    return out


def _holds(text: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def is_informational(text: Column) -> Column:
    """Whether a title holds a term of articles and learning pages."""
    return F.coalesce(_holds(F.lower(text), V.INFORMATIONAL_TERMS), F.lit(False))


def informational_term(text: Column) -> Column:
    """The first listed informational term that the text holds; null if none."""
    low = F.lower(text)
    return F.get(F.filter(F.array(*map(F.lit, V.INFORMATIONAL_TERMS)), lambda t: F.contains(low, t)), F.lit(0))


def is_company_name(name: Column) -> Column:
    """Two characters at least, and no placeholder."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(n) >= 2) & ~F.lower(n).isin(*V.NAME_PLACEHOLDERS)


def guessed_company(title: Column, url: Column) -> Column:
    """Company name of a search result: known host, a title part that is the host's name, the
    host for informational titles, parts with business words, the last part that is no phrase,
    the host."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    on_host = F.when(U.is_platform(url), U.profile_name(url)).otherwise(U.company_from_host(url))
    parts = F.filter(title_parts(title), lambda p: ~F.lower(p).isin(*V.TITLE_NOISE))

    def guessed(v: Column) -> Column:
        host_name = v["host"]
        business = F.filter(v["parts"], lambda p: _holds(F.lower(p), V.BUSINESS_HINTS))
        guess = F.coalesce(F.try_element_at(F.filter(v["parts"], lambda p: ~is_sentence(p)), F.lit(-1)), host_name)
        same = F.exists(v["parts"], lambda p: (plain(p) == plain(host_name)) & (plain(p) != ""))
        first = F.get(business, F.lit(0))
        return (
            F.when(F.trim(F.coalesce(v["title"], F.lit(""))) == "", host_name).when((host_name != "") & (same | is_informational(v["title"])), host_name)
            .when(first.isNotNull(), F.when(host_name != "", host_name).otherwise(first)).when(is_company_name(guess), guess).otherwise(host_name)
        )

    # the parts and the host's name are made once, whatever asks for them
    out = F.transform(F.array(F.struct(on_host.alias("host"), parts.alias("parts"), title.alias("title"))), guessed)[0]
    return U.override(U.domain_token(U.netloc(url)), out)


def profile_title_name(title: Column) -> Column:
    """Person's name from a profile's title: what stands before the first separator."""
    return F.trim(F.get(F.split(F.coalesce(title, F.lit("")), r"\s+-\s+|\s+\|\s+|\s*,\s+"), F.lit(0)))


def decomposed(text: Column) -> Column:
    """Text with compatibility forms and marks taken apart (NFKD): Spark has no expression for it."""
    import unicodedata

    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))

    return F.pandas_udf(run, "string")(text)


def rooted(text: Column) -> Column:
    """Words in lower case, possessives and punctuation (marks too) gone, common roots unified."""
    t = F.lower(decomposed(F.coalesce(text, F.lit(""))))
    t = F.regexp_replace(F.regexp_replace(t, r"'s\b|s'\b", ""), r"(?U)[^\p{L}\p{N}_\s]", " ")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    roots = F.create_map(*[F.lit(x) for kv in V.ROOTS.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(roots, w), w)), " ")


def without_location(keyword: Column) -> tuple[Column, Column]:
    """Keyword (lower case) without a place at its end, and the place in title case (or empty)."""
    words = F.filter(F.split(F.lower(F.trim(keyword)), r"\s+"), lambda w: w != "")
    last = F.try_element_at(words, F.lit(-1))
    has = (F.size(words) > 1) & last.isin(*V.LOCATIONS)
    rest = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.when(has, rest).otherwise(F.lower(F.trim(keyword))), F.when(has, title_case(last)).otherwise(F.lit(""))


def is_literal_match(blocks: Column, keyword: Column) -> Column:
    """Whether the texts (an array) hold the keyword or its first word, roots unified; no keyword: yes."""
    key = rooted(without_location(keyword)[0])
    target = rooted(F.array_join(F.filter(blocks, lambda b: F.coalesce(b, F.lit("")) != ""), " "))
    first = F.get(F.split(key, " "), F.lit(0))
    return F.when(F.coalesce(keyword, F.lit("")) == "", F.lit(True)).when(key == "", F.lit(False)).otherwise(F.contains(target, key) | F.contains(target, first))


def stripped_html(html: Column) -> Column:
    """Text of a page: tags out, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))
