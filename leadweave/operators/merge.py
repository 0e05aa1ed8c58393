"""Merging records: by domain, by best record, and keyed upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions import classify as C
from leadweave.functions import names as N

FIRST_WINS = ("company_name", "industry", "location", "contact_page", "about_page", "source", "website")


def first_known(column: str, order: str) -> Column:
    """First value by arrival that is not null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def union_of(column: str) -> Column:
    """Sorted distinct items of all arrays of a group. Built from sets, so partial
    aggregation already drops repeats."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(column), F.array().cast("array<string>"))))))


def merge_by_key(df: DataFrame, key: str = "domain", order: str = "ord") -> DataFrame:
    """One record for each key: first known scalars, united e-mails and phones, the last link
    of each network, people by name (last record at the first one's place; unnamed ones all
    stay). Rows without a key go. Give a history smaller orders than a batch."""
    df = df.filter(F.coalesce(F.col(key), F.lit("")) != "")
    scalars = [first_known(c, order).alias(c) for c in FIRST_WINS if c in df.columns]
    arrays = [union_of(c).alias(c) for c in ("emails", "phones") if c in df.columns]
    out = df.groupBy(key).agg(*scalars, *arrays, F.min(order).alias("first_ord"), F.count(F.lit(1)).alias("merged"))
    if "social_links" in df.columns:
        links = df.select(key, order, F.explode("social_links").alias("network", "link"))
        links = links.groupBy(key, "network").agg(F.max_by("link", order).alias("link"))
        links = links.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("network", "link")))).alias("social_links"))
        out = out.join(links, key, "left")
    if "people" in df.columns:
        p = df.select(key, order, F.posexplode("people").alias("i", "person"))
        place = F.struct(F.col(order).alias("o"), F.col("i").alias("i"))
        name = F.nullif(F.col("person.name"), F.lit(""))
        p = p.select(key, place.alias("place"), "person", F.coalesce(name, F.concat(F.lit("\u0001"), F.to_json(place))).alias("who"))
        p = p.groupBy(key, "who").agg(F.min("place").alias("first"), F.max_by("person", "place").alias("person"))
        p = p.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "person"))), lambda x: x["person"]).alias("people"))
        out = out.join(p, key, "left")
    return out


def best_record(df: DataFrame, key: Column, order: str = "ord", relevance: str = "relevance_score", source: str = "source", fill: tuple[str, ...] = ("website", "linkedin")) -> DataFrame:
    """The best record of each key: relevance, then source score, then arrival. Fields it lacks
    come from the first other record that has them."""
    rank = F.struct(F.coalesce(F.col(relevance), F.lit(0)).alias("a"), C.source_score(F.col(source)).alias("b"), (-F.col(order)).alias("c"))
    row = F.struct(*df.columns)
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    fills = [F.min_by(c, F.when(has(c), F.col(order))).alias(f"_fill_{c}") for c in fill]
    g = df.groupBy(key.alias("_key")).agg(F.max_by(row, rank).alias("r"), *fills)
    cols = [F.coalesce(F.nullif(F.col(f"r.{c}"), F.lit("")), F.col(f"_fill_{c}")).alias(c) if c in fill else F.col(f"r.{c}") for c in df.columns]
    return g.select(*cols)


def best_company(df: DataFrame, name: str = "company", **more) -> DataFrame:
    return best_record(df, N.name_key(F.col(name)), **more)


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Whole-row replace: the last row of each key. One shuffle, one row a key and task."""
    both = existing.unionByName(new, allowMissingColumns=True)
    row = F.struct(*both.columns)
    return both.groupBy(key).agg(F.max_by(row, order).alias("_r")).select("_r.*")
