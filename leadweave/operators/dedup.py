"""Keep-first and keep-best deduplication. Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.functions import names as N
from leadweave.functions import url as U


def keep_first(df: DataFrame, keys: list[Column], order: list[Column], duplicates: str | None = None) -> DataFrame:
    """The first row of each key; with `duplicates`, all rows and a flag instead."""
    keyed = df.select("*", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("_key"))
    ranked = keyed.withColumn("_place", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))
    if duplicates:
        return ranked.withColumn(duplicates, F.col("_place") > 1).drop("_key", "_place")
    return ranked.filter("_place = 1").drop("_key", "_place")


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def by_name_and_website(df: DataFrame, order: str, name: str = "company_name", website: str = "website") -> DataFrame:
    return keep_first(df, [_plain(F.col(name)), _plain(F.col(website))], [F.col(order)])


def by_company(df: DataFrame, order: str, name: str = "company") -> DataFrame:
    """Keep-first by name; rows without a name go."""
    return keep_first(df.filter(_plain(F.col(name)) != ""), [_plain(F.col(name))], [F.col(order)])


def by_canonical_url(df: DataFrame, order: str, url: str = "url") -> DataFrame:
    return keep_first(df, [U.canonical(F.col(url))], [F.col(order)])


def by_content(df: DataFrame, order: str, html: str = "html") -> DataFrame:
    """Keep-first by the SHA-256 of a page's text."""
    return keep_first(df, [F.sha2(N.stripped_html(F.col(html)), 256)], [F.col(order)])


def by_near_query(df: DataFrame, order: str, query: str = "query") -> DataFrame:
    return keep_first(df, [N.query_key(F.col(query))], [F.col(order)])


def fingerprint(method: Column, url: Column, query: Column, provider: Column) -> Column:
    """Identity of a request."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.sha1(F.concat_ws(":", F.upper(empty(method)), empty(url), empty(query), empty(provider)).cast("binary"))


def distinct_items(items: Column) -> Column:
    """Array without later spellings of an item (letter case and outer blanks aside)."""
    keys = F.transform(items, lambda x: F.lower(F.trim(x)))
    return F.filter(items, lambda x, i: (F.trim(x) != "") & (F.array_position(keys, F.lower(F.trim(x))) == i + 1))


def distinct_people(people: Column) -> Column:
    """People without later rows of the same name and designation."""
    key = lambda p: F.concat_ws("\u0001", F.lower(F.trim(F.coalesce(p["name"], F.lit("")))), F.lower(F.trim(F.coalesce(p["designation"], F.lit("")))))
    keys = F.transform(people, key)
    return F.filter(people, lambda p, i: F.array_position(keys, key(p)) == i + 1)
