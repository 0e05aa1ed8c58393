"""Joins with dictionaries and lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions import names as N
from leadweave.functions import values as V


def with_default(left: DataFrame, right: DataFrame, key: str, order: str, default: Column, name: str) -> DataFrame:
    """Left join with the last right row of each key; a default where there is none."""
    row = F.struct(*[c for c in right.columns if c not in (key, order)])
    last = right.groupBy(key).agg(F.max_by(row, order).alias(name))
    return left.join(last, key, "left").withColumn(name, F.coalesce(name, default))


def listed(df: DataFrame, key: Column, blocklist: DataFrame, column: str, keep: bool) -> DataFrame:
    """Rows whose key is in the list (keep) or is not."""
    b = blocklist.select(F.col(column).alias("_b")).distinct()
    return df.join(b, key == F.col("_b"), "left_semi" if keep else "left_anti")


#: Terms up to which a dictionary travels to the texts.
SMALL_DICTIONARY = 50_000


def term_hits(docs: DataFrame, key: str, text: str, terms: DataFrame, term: str, longest: int = 3) -> DataFrame:
    """key, term, hits of dictionary terms (up to so many words) in texts.

    Texts become n-grams and meet the dictionary in a hash join, before anything is grouped:
    only hits are shuffled. The dictionary is broadcast if it is small (it is counted).
    """
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    d = docs.select(F.col(key), w.alias("w"))
    t = terms.select(F.lower(term).alias("_t"), F.col(term).alias("term")).distinct()
    if t.limit(SMALL_DICTIONARY + 1).count() <= SMALL_DICTIONARY:
        t = F.broadcast(t)
    g = d.select(key, F.explode("w").alias("_t"))
    for n in range(2, longest + 1):
        at = F.sequence(F.lit(1), F.size("w") - (n - 1))
        g = g.unionByName(d.filter(F.size("w") >= n).select(key, F.explode(F.transform(at, _gram(n))).alias("_t")))
    return g.join(t, "_t").groupBy(key, "term").agg(F.count(F.lit(1)).alias("hits"))


def _gram(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


def best_class(hits: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """Class with the most weighted hits of each key; ties go to the smaller ordinal.
    classes: term, label, ordinal, weight."""
    g = hits.join(classes, "term").groupBy(key, "label", "ordinal").agg(F.sum(F.col("hits") * F.col("weight")).alias("score"))
    best = g.groupBy(key).agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"), "label")).alias("b"))
    return best.select(key, F.col("b.label").alias("label"), F.col("b.score").alias("score"))


#: Length of the pieces by which words are found inside terms.
PIECE = 3


def _pieces(c: Column, n: int) -> Column:
    """All distinct pieces of so many characters."""
    at = F.sequence(F.lit(1), F.length(c) - (n - 1))
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(words: DataFrame, terms: DataFrame, value: Column) -> DataFrame:
    """q, best: for each word of q that is part of a term, the least value of those terms.

    Equi-joins only. A word of up to PIECE characters is itself a piece, and terms keep their
    least value for each piece; a longer word meets the terms that have its rarest piece, and
    is looked for in those. Nothing is broadcast but what the session's own limit allows.
    words: q, distinct; terms: term and the columns of value. Null and empty words and terms
    give nothing.
    """
    t = terms.select("term", value.alias("v")).groupBy("term").agg(F.min("v").alias("v"))
    w = words.select("q").filter("q <> ''")
    pieces = F.flatten(F.array(*[_pieces(F.col("term"), n) for n in range(1, PIECE + 1)]))
    least = t.select(F.explode(pieces).alias("q"), "v").groupBy("q").agg(F.min("v").alias("best"))
    short = w.filter(F.length("q") <= PIECE).join(least, "q").select("q", "best")

    posted = t.select("term", "v", F.explode(_pieces(F.col("term"), PIECE)).alias("piece"))
    asked = w.filter(F.length("q") > PIECE).select("q", F.explode(_pieces(F.col("q"), PIECE)).alias("piece"))
    often = posted.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(often, "piece", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r"))
    rarest = rarest.filter("r.n > 0").select("q", F.col("r.piece").alias("piece"))
    long = rarest.join(posted, "piece").filter(F.contains("term", "q")).groupBy("q").agg(F.min("v").alias("best"))
    return short.unionByName(long)


def closest_domain(keywords: DataFrame, ontology: DataFrame) -> DataFrame:
    """keyword, domain: an exact key, an exact term, else the shortest key or term that contains
    the keyword (then by the ontology's order); null if there is none."""
    low = F.lower(F.trim("keyword"))
    k = keywords.select(low.alias("q")).filter("q <> ''").distinct()
    o = ontology.select("domain", F.lower("term").alias("term"), "ordinal")
    keys = o.groupBy("domain").agg(F.min("ordinal").alias("ordinal")).select("domain", F.lower("domain").alias("term"), (F.col("ordinal") - 0.5).alias("ordinal"), F.lit(0).alias("exact"))
    entries = keys.unionByName(o.select("domain", "term", F.col("ordinal").cast("double").alias("ordinal"), F.lit(1).alias("exact")))
    ranked = lambda rank, size: F.struct(rank.alias("rank"), size.alias("size"), "ordinal", "domain")
    same = entries.groupBy("term").agg(F.min(ranked(F.col("exact"), F.lit(0))).alias("best"))
    named = k.select("q", F.explode(F.array_distinct(F.array("q", F.lower(N.concept(F.col("q")))))).alias("term"))
    exact = named.join(same, "term").select("q", "best")
    part = containing(k, entries, ranked(F.lit(2), F.length("term")))
    found = exact.unionByName(part).groupBy("q").agg(F.min("best").alias("b"))
    return keywords.withColumn("_q", low).join(found.select(F.col("q").alias("_q"), F.col("b.domain").alias("domain")), "_q", "left").select(*keywords.columns, "domain")


def resolved_intent(keywords: DataFrame, ontology: DataFrame) -> DataFrame:
    """keyword, primary_domain, concepts, positions, services, products, confidence: the domains
    of the keyword and of its words together; made-up terms for keywords without any."""
    low = F.lower(F.trim("keyword"))
    words = F.filter(F.split(low, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*V.DOMAIN_NOISE))
    k = keywords.select(F.col("keyword").alias("kw"), low.alias("q"), words.alias("w")).distinct()
    asked = k.select("kw", F.posexplode(F.concat(F.array("q"), "w")).alias("place", "keyword"))
    found = asked.join(closest_domain(asked.select("keyword").distinct(), ontology), "keyword").filter("domain IS NOT NULL").groupBy("kw", "domain").agg(F.min("place").alias("place"))
    terms = ontology.groupBy("domain").agg(*[F.array_sort(F.collect_set(F.when(F.col("channel") == c, F.col("term")))).alias(c) for c in ("concepts", "positions", "services", "products")])
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    g = found.join(terms, "domain").groupBy("kw").agg(F.array_sort(F.collect_list(F.struct("place", "domain"))).alias("d"), *[sets(c) for c in ("concepts", "positions", "services", "products")])
    g = g.select("kw", F.array_join(F.transform("d", lambda x: N.title_case(x["domain"])), " + ").alias("primary_domain"), "concepts", "positions", "services", "products", F.when(F.size("d") == 1, 1.0).otherwise(0.7).alias("confidence"))
    name = N.concept(F.col("q"))
    made = lambda *ends: F.array_sort(F.array_distinct(F.array(*[N.concept(F.concat(name, F.lit(" " + e))) for e in ends])))
    own = F.array_sort(F.array_distinct(F.concat(F.array(name), F.transform("w", N.concept), F.col("w"))))
    alone = k.join(g.select("kw"), "kw", "left_anti").select(
        "kw", name.alias("primary_domain"), own.alias("concepts"), made("Developer", "Engineer", "Specialist").alias("positions"), made("Development", "Consulting", "Solutions", "Services").alias("services"),
        F.array().cast("array<string>").alias("products"), F.lit(0.4).alias("confidence"),
    )
    return g.unionByName(alone).withColumnRenamed("kw", "keyword")


#: Weights of an ontology's channels.
CHANNEL_WEIGHTS = {"concepts": 2.0, "products": 1.5, "services": 1.5, "positions": 1.0}


def ontology_industry(docs: DataFrame, key: str, text: str, ontology: DataFrame) -> DataFrame:
    """key, industry, score: the domain with the most weighted hits by the root of its number of
    terms; the first in the ontology of equal ones; texts without a hit are Unknown."""
    weight = F.lit(0.0)
    for c, w in CHANNEL_WEIGHTS.items():
        weight = F.when(F.col("channel") == c, F.lit(w)).otherwise(weight)
    size = ontology.groupBy("domain").agg(F.count(F.lit(1)).alias("terms"), F.min("ordinal").alias("first"))
    hits = term_hits(docs, key, text, ontology, "term")
    g = hits.join(ontology.select("term", "domain", weight.alias("weight")), "term").groupBy(key, "domain").agg(F.sum(F.col("hits") * F.col("weight")).alias("s"))
    g = g.join(size, "domain").withColumn("score", F.col("s") / F.sqrt(F.greatest(F.lit(1), "terms")))
    best = g.groupBy(key).agg(F.max(F.struct("score", (-F.col("first")).alias("o"), "domain")).alias("b"))
    out = docs.select(key).join(best, key, "left")
    return out.select(key, F.coalesce(N.title_case(F.col("b.domain")), F.lit("Unknown")).alias("industry"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def promoted(learned: DataFrame, ontology: DataFrame, confidence: float = 0.75, accepted: int = 3) -> DataFrame:
    """The ontology with learned terms that are sure enough."""
    new = learned.filter((F.col("confidence") >= confidence) & (F.col("accepted") >= accepted)).select(F.col("keyword").alias("domain"), F.col("target_field").alias("channel"), "term", F.lit(1 << 30).alias("ordinal"))
    return ontology.select("domain", "channel", "term", "ordinal").unionByName(new).groupBy("domain", "channel", "term").agg(F.min("ordinal").alias("ordinal"))


def learned_terms(seen: DataFrame) -> DataFrame:
    """Statistics of observed terms (keyword, term, target_field, accepted boolean, day)."""
    g = seen.groupBy("keyword", "term", "target_field").agg(F.count(F.lit(1)).alias("seen"), F.count_if("accepted").alias("accepted"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    return g.withColumn("confidence", F.bround(F.col("accepted") / F.col("seen"), 2))
