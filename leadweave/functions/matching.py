"""How well a company's texts fit a keyword's intent: weighted parts, literal bonus, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave.functions import values as V

#: Weights of a page's and of a search result's parts.
PAGE_WEIGHTS = {"description": 30.0, "services": 25.0, "technologies": 20.0, "products": 10.0, "positions": 10.0, "blog": 5.0}
SNIPPET_WEIGHTS = {"title": 20.0, "description": 30.0, "positions": 10.0}
LITERAL_BONUS = 40


def matching(text: Column, terms: Column) -> Column:
    """The terms that the text holds as words, or one of whose synonyms it holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    table = F.create_map(*[x for k, xs in V.SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, xs)))])

    def held(t: Column) -> Column:
        t = F.lower(t)
        words = F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))
        pattern = F.concat(F.lit(r"(?U)\b(?:"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|"), F.lit(r")\b"))
        return F.rlike(low, pattern) | (t.isin("electronics", "electronic") & low.contains("electron"))

    return F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: (F.coalesce(t, F.lit("")) != "") & held(t))


def _some(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0)) > 0


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Score 0 to 100 (truncated) of the parts that match."""
    s = sum((F.when(F.coalesce(parts[k], F.lit(False)), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return (s / sum(weights.values()) * 100.0).cast("int")


def snippet_score(title: Column, snippet: Column, positions: Column, concepts: Column, wanted: Column) -> Column:
    """Score of a search result: its title and text hold a concept, one of its positions is part of a wanted one."""
    fits = F.exists(F.coalesce(positions, F.array().cast("array<string>")), lambda p: F.exists(wanted, lambda w: F.contains(F.lower(w), F.lower(p))))
    return weighted({"title": _some(matching(title, concepts)), "description": _some(matching(snippet, concepts)), "positions": fits}, SNIPPET_WEIGHTS)


def page_score(profile: Column, services: Column, products: Column, blog: Column, concepts: Column, wanted_services: Column, wanted_products: Column, wanted_positions: Column) -> Column:
    """Score of a page's profile (struct with description, technologies, positions) and its sections' texts."""
    said = lambda c: F.array_join(c, " ")
    parts = {
        "description": _some(matching(profile["description"], concepts)), "services": _some(matching(services, F.array_union(wanted_services, concepts))), "technologies": _some(matching(said(profile["technologies"]), concepts)),
        "products": _some(matching(products, wanted_products)), "positions": _some(matching(said(profile["positions"]), wanted_positions)), "blog": _some(matching(blog, concepts)),
    }
    return weighted(parts, PAGE_WEIGHTS)


def tier(score: Column) -> Column:
    return F.when(score >= 80, F.lit("HIGH")).when(score >= 60, F.lit("MEDIUM")).when(score >= 40, F.lit("LOW")).otherwise(F.lit("REJECT"))


def relevance(score: Column, literal: Column, mode: str = "semantic") -> Column:
    """struct(score, tier): a literal match adds its bonus; in exact mode nothing counts without one."""
    s = F.when(literal, F.least(F.lit(100), score + LITERAL_BONUS)).otherwise(score)
    if mode == "exact":
        return F.struct(F.when(literal, s).otherwise(0).alias("score"), F.when(literal, tier(s)).otherwise(F.lit("REJECT")).alias("tier"))
    return F.struct(s.alias("score"), tier(s).alias("tier"))
