"""Structured Streaming versions of the stateful parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadweave.functions import names as N
from leadweave.functions import url as U


def fold_breaker(state: tuple[str, float, float, int], events: list[tuple[float, bool]], points: float = 4.0, limit: float = 10.0, cooldown: int = 600) -> tuple[str, float, float, int]:
    """State, points, open until, trips of a scored breaker after events (seconds, failed)."""
    s, p, until, trips = state
    for t, failed in events:
        if s == "OPEN" and t >= until:
            s = "HALF_OPEN"
        if s == "OPEN":
            continue
        if s == "HALF_OPEN":
            s, p = ("OPEN", p) if failed else ("CLOSED", 0.0)
        else:
            p = p + points if failed else max(0.0, p - 1)
            if failed and p >= limit:
                s = "OPEN"
        if s == "OPEN":
            until, trips = t + cooldown, trips + 1
    return s, p, until, trips


def breaker(events: DataFrame, points: float = 4.0, limit: float = 10.0, cooldown: int = 600) -> DataFrame:
    """Breaker state of each entity; events: entity, ord, t (seconds), failed. Order within a
    trigger is by ord, as in batch."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("CLOSED", 0.0, 0.0, 0)
        rows = pd.concat(list(parts)).sort_values("ord")
        now = fold_breaker(tuple(now), list(zip(rows["t"].astype(float), rows["failed"].astype(bool))), points, limit, cooldown)
        state.update(now)
        yield pd.DataFrame({"entity": [key[0]], "state": [now[0]], "points": [now[1]], "trips": [now[3]]})

    return events.groupBy("entity").applyInPandasWithState(run, "entity string, state string, points double, trips long", "state string, points double, until double, trips long", "update", GroupStateTimeout.NoTimeout)


def bucket(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """Requests of each entity that a token bucket lets through; events: entity, ord, t."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last, passed = state.get if state.exists else (burst, -1.0, 0)
        for t in pd.concat(list(parts)).sort_values("ord")["t"].astype(float):
            tokens = min(burst, tokens + max(0.0, t - last) * rate) if last >= 0 else tokens
            last = t
            if tokens >= 1:
                tokens, passed = tokens - 1, passed + 1
        state.update((tokens, last, passed))
        yield pd.DataFrame({"entity": [key[0]], "passed": [passed]})

    return events.groupBy("entity").applyInPandasWithState(run, "entity string, passed long", "tokens double, last double, passed long", "update", GroupStateTimeout.NoTimeout)


#: Pages of one domain that a crawl takes.
PAGES_A_DOMAIN = 15


def frontier(pages: DataFrame, ts: str, delay: str = "1 hour") -> DataFrame:
    """Pages whose crawl URL was not seen before within the watermark, with their content's hash."""
    d = pages.withWatermark(ts, delay).withColumn("crawl_url", U.crawl_canonical(F.col("url")))
    return d.dropDuplicatesWithinWatermark(["crawl_url"]).withColumn("content_hash", F.sha2(N.stripped_html(F.col("html")), 256))


def within_budget(pages: DataFrame, most: int = PAGES_A_DOMAIN) -> DataFrame:
    """domain, ord, url of a stream's pages (ord, url) while their domain has had fewer than so
    many; the count of each domain is the state. In a trigger, pages go by ord."""
    d = pages.select(U.host(F.col("url")).alias("domain"), "ord", "url")

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = state.get[0] if state.exists else 0
        for part in parts:
            take = part.sort_values("ord").head(max(0, most - had))
            had += len(take)
            yield take[["domain", "ord", "url"]]
        state.update((had,))

    return d.groupBy("domain").applyInPandasWithState(run, "domain string, ord long, url string", "had long", "append", GroupStateTimeout.NoTimeout)


def crawl_budget(pages: DataFrame, order: str, most: int = PAGES_A_DOMAIN) -> DataFrame:
    """In batch: the first page of each crawl URL, and of these the first so many of each domain."""
    d = pages.withColumn("crawl_url", U.crawl_canonical(F.col("url"))).withColumn("domain", U.host(F.col("url")))
    first = Window.partitionBy("crawl_url").orderBy(order)
    d = d.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def windowed(events: DataFrame, ts: str, keys: list[str], delay: str, size: str, slide: str | None = None, **aggs: Column) -> DataFrame:
    """Extension: tumbling or sliding windows with late data up to a delay."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(*[c.alias(k) for k, c in aggs.items()]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggs)


def sessions(events: DataFrame, ts: str, keys: list[str], delay: str, gap: str) -> DataFrame:
    """Extension: session windows."""
    d = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return d.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events")


def counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running totals, for update mode: the signal bus's trackers."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))


def merge_batches(stream: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame], checkpoint: str):
    """Merges every micro-batch into a table kept by snapshots. A batch that ran before (same
    id) is skipped, so a restart doesn't merge twice."""
    from leadweave.sources.readers import master
    from leadweave.sources.sinks import write_snapshot

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = master(spark, path)
        if old is not None and "_batch" in old.columns:
            seen = old.agg(F.max("_batch")).first()[0]
            if seen is not None and seen >= number:
                return
        out = merge(batch, old.drop("_batch") if old is not None else None)
        write_snapshot(out.withColumn("_batch", F.lit(number).cast("long")), path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
