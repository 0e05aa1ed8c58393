"""Ranking, interleaving and top-k, always with a total order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, score: str, order: str) -> DataFrame:
    return df.orderBy(F.desc(score), order)


def budgeted(df: DataFrame, query: str, weight: str, order: str, n: int) -> DataFrame:
    """The first n queries: general ones before site searches, each by weight, then order."""
    return df.orderBy(F.lower(query).contains("site:"), F.desc(weight), order).limit(n)


def round_robin(df: DataFrame, host: Column, order: str, place: str = "place") -> DataFrame:
    """Hosts take turns, in the order in which they first occur."""
    d = df.select("*", host.alias("_host"))
    d = d.withColumn("_turn", F.row_number().over(Window.partitionBy("_host").orderBy(order))).withColumn("_first", F.min(order).over(Window.partitionBy("_host")))
    d = d.withColumn(place, F.struct("_turn", "_first"))
    return d.orderBy("_turn", "_first").select(*df.columns, F.col("_turn").alias("turn"))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page number (from 1) of a stable order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def per_group(df: DataFrame, groups: list[str], n: int, *order: Column, name: str | None = None) -> DataFrame:
    """The first n of each group, with their places if a name is given; Spark limits groups
    before the shuffle already."""
    d = df.withColumn("_place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("_place") <= n)
    return d.withColumnRenamed("_place", name) if name else d.drop("_place")


def priority_queue(requests: DataFrame, priorities: DataFrame | None = None) -> DataFrame:
    """Requests (priority, depth, ts, seq, provider) in the order in which a queue hands them out.
    priorities (provider, priority): new ones for all waiting requests of a provider."""
    d = requests
    if priorities is not None:
        new = priorities.groupBy("provider").agg(F.max("priority").alias("_new"))
        d = d.join(new, "provider", "left").withColumn("priority", F.coalesce("_new", "priority")).drop("_new")
    return d.orderBy(F.desc("priority"), "depth", "ts", "seq")


def provider_order(providers: DataFrame) -> DataFrame:
    """provider, place: by position in the list (from 0), ten later below a success rate of 0.2,
    one earlier above 0.8 if free, a hundred later if unhealthy or open; then by success rate, position and provider.
    Columns: provider, position, queries, failures, cost, healthy, breaker."""
    rate = F.when(F.coalesce(F.col("queries"), F.lit(0)) > 0, (F.col("queries") - F.col("failures")) / F.col("queries")).otherwise(1.0)
    i = F.col("position") + F.when(rate < 0.2, 10).when((rate > 0.8) & (F.col("position") > 0) & (F.col("cost") == 0), -1).otherwise(0)
    i = i + F.when(~F.coalesce(F.col("healthy"), F.lit(True)) | (F.coalesce(F.col("breaker"), F.lit("CLOSED")) == "OPEN"), 100).otherwise(0)
    d = providers.select("provider", "position", i.alias("_i"), rate.alias("success_rate"))
    return d.withColumn("place", F.row_number().over(Window.orderBy("_i", F.desc("success_rate"), "position", "provider"))).select("provider", "place", "success_rate")  # a row for each provider


def explored(ordered: DataFrame, run: str, seed: int = 0, share: float = 0.1) -> DataFrame:
    """In a share of the runs (column `run`) one free provider, drawn by a hash, moves to the front of
    the free ones. Columns: run, provider, place, cost."""
    def draw(*keys) -> Column:
        return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)

    free = F.col("cost") == 0
    per_run = Window.partitionBy(run)
    d = ordered.withColumn("_first", F.min(F.when(free, F.col("place"))).over(per_run)).withColumn("_free", F.count_if(free).over(per_run))
    luck = F.when(free & (F.col("place") > F.col("_first")), draw(F.col(run), F.col("provider")))
    d = d.withColumn("_luck", luck).withColumn("_best", F.max("_luck").over(per_run))
    go = (draw(F.col(run)) < share) & (F.col("_free") > 1) & (F.col("_luck") == F.col("_best"))
    key = F.when(F.coalesce(go, F.lit(False)), F.col("_first") - 0.5).otherwise(F.col("place").cast("double"))
    return d.withColumn("_key", key).withColumn("place", F.row_number().over(per_run.orderBy("_key"))).select(*ordered.columns)


def renumbered(df: DataFrame, *order: Column, groups: list[str], name: str = "rank") -> DataFrame:
    """Places from 1 in each group after a merge."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn by weight without replacement; a hash of key and seed draws, so reruns agree."""
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
    return df.filter(F.col(weight) > 0).orderBy(F.desc(F.log(u) / F.col(weight)), key).limit(n)


#: Fixed value: items times concepts, and common words of them, that are counted at once.
CELLS = 1 << 22


def _nearest_by_words(items: DataFrame, words: list[tuple[str, list[int]]], sizes: list[int], roi: list[float], n: int) -> DataFrame:
    """k, place (a concept's place by term), common, score: the first n concepts of each row (k, nw, w)
    by score, then place. The table of words is held whole; the rows need no shuffle."""
    vocabulary = pa.array([x for x, _ in words], pa.string())
    flat = np.array([c for _, cs in words for c in cs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum([len(cs) for _, cs in words])]).astype(np.int64)
    nv, bonus = np.array(sizes, dtype=np.int64), 0.4 * np.array(roi) / 10
    each, out = max(1, CELLS // max(len(sizes), len(flat))), "k long, place long, common long, score double"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, each):
                part = batch.slice(at, each)
                row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(part["w"]), 0).to_numpy(zero_copy_only=False))
                word = pc.fill_null(pc.index_in(part["w"].flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row, word = row[word >= 0], word[word >= 0]
                counts = starts[word + 1] - starts[word]
                places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[word], counts)
                common = np.bincount(np.repeat(row, counts) * len(nv) + flat[places], minlength=part.num_rows * len(nv)).reshape(part.num_rows, len(nv))
                nw = pc.fill_null(part["nw"], 0).to_numpy(zero_copy_only=False).astype(np.int64)[:, None]
                score = np.where(common > 0, 0.6 * common / np.maximum(nw + nv - common, 1) + bonus, -np.inf)
                for _ in range(min(n, len(nv))):
                    best, r = score.argmax(axis=1), np.arange(part.num_rows)
                    r = r[score[r, best] > -np.inf]
                    best = best[r]
                    yield pa.RecordBatch.from_arrays([part["k"].take(pa.array(r)), pa.array(best), pa.array(common[r, best]), pa.array(score[r, best])], ["k", "place", "common", "score"])
                    score[r, best] = -np.inf

    return items.mapInArrow(run, out.replace("k long", f"k {items.schema['k'].dataType.simpleString()}"))


def nearest_concepts(items: DataFrame, words: Column, concept: DataFrame, n: int, key: str, small: int = 1_000_000) -> DataFrame:
    """For each item the n concepts by 0.6 word overlap (Jaccard) and 0.4 yield (roi / 10).

    concept(term, roi) is a dictionary: its words (they are counted) travel to the items while
    there are at most `small`, and each item's first n are chosen where it is read; else both meet
    in a shuffled join. Pairs without a common word are never made, and a term's number stands for
    its text until the first n are chosen.
    """
    c = concept.groupBy("term").agg(F.max("roi").cast("double").alias("roi"))
    c = c.select(F.xxhash64("term").alias("id"), "term", "roi", F.array_distinct(F.filter(F.split(F.lower("term"), r"\s+"), lambda w: w != "")).alias("v"))
    by_word = c.select("id", F.explode("v").alias("x"))
    i = items.select(F.col(key).alias("k"), F.array_distinct(words).alias("w"))
    if by_word.limit(small + 1).count() <= small:
        terms = sorted(c.filter(F.size("v") > 0).select("term", "roi", "v").collect(), key=lambda t: t.term.encode())  # at most `small`
        holders = {}
        for place, t in enumerate(terms):
            for x in t.v:
                holders.setdefault(x, []).append(place)
        listed = items.sparkSession.createDataFrame([(p, t.term) for p, t in enumerate(terms)], "place long, term string")
        if not terms:
            return i.limit(0).select(F.col("k").alias(key), F.lit("").alias("term"), F.lit(0).cast("long").alias("common"), F.lit(0.0).alias("score"))
        g = _nearest_by_words(i.select("k", F.size("w").alias("nw"), "w"), list(holders.items()), [len(t.v) for t in terms], [t.roi for t in terms], n)
        return per_group(g, ["k"], n, F.desc("score"), F.col("place")).join(F.broadcast(listed), "place").select(F.col("k").alias(key), "term", "common", "score")
    g = i.select("k", F.size("w").alias("nw"), F.explode("w").alias("x")).join(by_word, "x").groupBy("k", "nw", "id").agg(F.count(F.lit(1)).alias("common"))
    g = g.join(c.select("id", "term", "roi", F.size("v").alias("nv")), "id")
    g = g.withColumn("score", 0.6 * F.col("common") / (F.col("nw") + F.col("nv") - F.col("common")) + 0.4 * F.col("roi") / 10)
    return per_group(g, ["k"], n, F.desc("score"), F.col("term")).select(F.col("k").alias(key), "term", "common", "score")
