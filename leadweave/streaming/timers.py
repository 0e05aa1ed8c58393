"""Breakers, quarantines and caches whose state moves with time, not only with events.

One stateful processor runs any machine: a small class that says how an event changes its state,
when the state is due to change by itself, and how. The due time is an event-time timer, so a
breaker half-opens and a quarantine ends when the watermark passes it, without an event. In a
trigger events go by time, then ord; an event at or after the due time finds the state moved.
Caches keep entries with a life time (TTL) in processing time; what is past it falls out of the
state store. Both need the RocksDB state store: use_state_store().
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leadweave.functions import url as U
from leadweave.streaming.state import PAGES_A_DOMAIN, fold_breaker

#: Seconds that a cached answer counts: with results, without any, and of a page.
RESULTS_TTL, EMPTY_TTL, PAGE_TTL = 24 * 3600, 30 * 60, 30 * 86_400


def use_state_store(spark: SparkSession) -> None:
    """Sets the state store that timers and TTL need, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- machines: state is a list that JSON can hold ------------------------------------------------------


@dataclass(frozen=True)
class ScoredBreaker:
    """Failures add points, successes take one; open at the limit, one probe after the cooldown. State: name, points, until, trips."""

    points: float = 4.0
    limit: float = 10.0
    cooldown: float = 600.0

    def start(self) -> list:
        return ["CLOSED", 0.0, 0.0, 0]

    def name(self, s: list) -> str:
        return s[0]

    def on_event(self, s: list, t: float, failed: bool) -> list:
        return list(fold_breaker(tuple(s), [(t, failed)], self.points, self.limit, self.cooldown))

    def due(self, s: list) -> float | None:
        return s[2] if s[0] == "OPEN" else None

    def on_time(self, s: list) -> list:
        return ["HALF_OPEN", *s[1:]]


@dataclass(frozen=True)
class RatioBreaker:
    """Opens when so large a share of the last outcomes failed; probes after each next longer wait. State: name, until, good, step, opens, last."""

    window: int = 20
    least: int = 6
    share: float = 0.8
    waits: tuple[float, ...] = (60.0, 120.0, 300.0, 600.0)
    probes: int = 2

    def start(self) -> list:
        return ["CLOSED", 0.0, 0, 0, 0, []]

    def name(self, s: list) -> str:
        return s[0]

    def _wait(self, step: int) -> float:
        return self.waits[min(step, len(self.waits) - 1)]

    def on_event(self, s: list, t: float, failed: bool) -> list:
        name, until, good, step, opens, last = s
        if name == "OPEN":
            return s
        if name == "PROBE":
            if failed:
                return ["OPEN", t + self._wait(step + 1), 0, step + 1, opens + 1, last]
            return ["CLOSED", 0.0, 0, 0, opens, []] if good + 1 >= self.probes else ["PROBE", until, good + 1, step, opens, last]
        last = [failed, *last][: self.window]
        if len(last) >= self.least and sum(last) / len(last) >= self.share:
            return ["OPEN", t + self._wait(step), 0, step, opens + 1, last]
        return ["CLOSED", until, 0, step, opens, last]

    def due(self, s: list) -> float | None:
        return s[1] if s[0] == "OPEN" else None

    def on_time(self, s: list) -> list:
        return ["PROBE", s[1], 0, *s[3:]]


@dataclass(frozen=True)
class StreakBreaker:
    """Opens at so many failures in a row for a while; restart: whether the count starts anew then. State: name, until, streak, opens, skipped."""

    limit: int = 10
    cooldown: float = 1200.0
    restart: bool = False

    def start(self) -> list:
        return ["CLOSED", 0.0, 0, 0, 0]

    def name(self, s: list) -> str:
        return s[0]

    def on_event(self, s: list, t: float, failed: bool) -> list:
        name, until, streak, opens, skipped = s
        if name == "OPEN":
            return ["OPEN", until, streak, opens, skipped + 1]
        streak = streak + 1 if failed else 0
        if failed and streak >= self.limit:
            return ["OPEN", t + self.cooldown, streak, opens + 1, skipped]
        return ["CLOSED", until, streak, opens, skipped]

    def due(self, s: list) -> float | None:
        return s[1] if s[0] == "OPEN" else None

    def on_time(self, s: list) -> list:
        return ["CLOSED", s[1], 0 if self.restart else s[2], *s[3:]]


@dataclass(frozen=True)
class Quarantine:
    """Each failure shuts an entity out for the next longer wait; a success after it starts over. State: name, until, step."""

    waits: tuple[float, ...] = (30.0, 60.0, 120.0, 300.0)

    def start(self) -> list:
        return ["FREE", 0.0, 0]

    def name(self, s: list) -> str:
        return s[0]

    def on_event(self, s: list, t: float, failed: bool) -> list:
        if s[0] == "OUT":
            return s
        return ["OUT", t + self.waits[min(s[2], len(self.waits) - 1)], s[2] + 1] if failed else ["FREE", 0.0, 0]

    def due(self, s: list) -> float | None:
        return s[1] if s[0] == "OUT" else None

    def on_time(self, s: list) -> list:
        return ["FREE", *s[1:]]


def moves(machine, state: list, events: Iterable[tuple[float, bool]], until: float | None = None) -> tuple[list, list[tuple[float, str]]]:
    """State after events in order (and after the clock reached `until`), and each change of its name with its time."""
    out = []

    def to(new: list, t: float) -> list:
        if machine.name(new) != machine.name(state):
            out.append((t, machine.name(new)))
        return new

    for t, failed in events:
        while (due := machine.due(state)) is not None and due <= t:
            state = to(machine.on_time(state), due)
        state = to(machine.on_event(state, t, failed), t)
    while until is not None and (due := machine.due(state)) is not None and due <= until:
        state = to(machine.on_time(state), due)
    return state, out


class _Timed(StatefulProcessor):
    """A machine for each key: its state as JSON, its due time as a timer."""

    def __init__(self, machine) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("machine", "state string")

    def _state(self) -> list:
        return json.loads(self.value.get()[0]) if self.value.exists() else self.machine.start()

    def _keep(self, key: tuple, state: list, out: list[tuple[float, str]]) -> Iterator[pd.DataFrame]:
        self.value.update((json.dumps(state),))
        due = self.machine.due(state)
        at = None if due is None else round(due * 1000)
        had = list(self.handle.listTimers())
        for t in had:
            if t != at:
                self.handle.deleteTimer(t)
        if at is not None and at not in had:
            self.handle.registerTimer(at)
        if out:
            yield pd.DataFrame({"entity": [key[0]] * len(out), "t": [float(t) for t, _ in out], "state": [n for _, n in out], "detail": [json.dumps(state)] * len(out)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values(["t", "ord"])
        state, out = moves(self.machine, self._state(), zip(d["t"].astype(float), d["failed"].astype(bool)))
        yield from self._keep(key, state, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = moves(self.machine, self._state(), (), expiredTimerInfo.getExpiryTimeInMs() / 1000)
        yield from self._keep(key, state, out)

    def close(self) -> None:
        pass


def timed(events: DataFrame, machine, delay: str = "10 seconds") -> DataFrame:
    """entity, t, state, detail: each change of each entity's machine, by an event or by its timer.
    events: entity, ord, ts (timestamp), failed. Null failed: no failure. Null ts: no event."""
    d = events.filter("ts IS NOT NULL").select("entity", "ord", "ts", (F.unix_micros("ts") / 1e6).alias("t"), F.coalesce("failed", F.lit(False)).alias("failed")).withWatermark("ts", delay)
    return d.groupBy("entity").transformWithStateInPandas(_Timed(machine), "entity string, t double, state string, detail string", "Update", "EventTime")


# --- caches --------------------------------------------------------------------------------------------


class _Cached(StatefulProcessor):
    """Answers of a key for as long as they count: two values with life times of their own."""

    def __init__(self, results_ttl: float, empty_ttl: float) -> None:
        self.ttl = (results_ttl, empty_ttl)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.full = handle.getValueState("results", "n long", round(self.ttl[0] * 1000))
        self.empty = handle.getValueState("empty", "n long", round(self.ttl[1] * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values("ord")
        held = self.full.get()[0] if self.full.exists() else self.empty.get()[0] if self.empty.exists() else None
        cached, answers, asked = [], [], False
        for n in d["results"].astype("Int64"):
            cached.append(held is not None)
            if held is None:  # asked for real: the answer is kept from now on
                held, asked = int(n), True
            answers.append(held)
        if asked:
            (self.full if held else self.empty).update((held,))
        yield pd.DataFrame({"key": [key[0]] * len(d), "ord": d["ord"].tolist(), "cached": cached, "results": answers})

    def close(self) -> None:
        pass


def cached_answers(asks: DataFrame, results_ttl: float = RESULTS_TTL, empty_ttl: float = EMPTY_TTL) -> DataFrame:
    """key, ord, cached, results of each ask (key, ord, results: what asking for real would bring): from
    the cache while an answer counts, shorter for empty ones. Null results count as none."""
    d = asks.select("key", "ord", F.coalesce(F.col("results").cast("long"), F.lit(0)).alias("results"))
    return d.groupBy("key").transformWithStateInPandas(_Cached(results_ttl, empty_ttl), "key string, ord long, cached boolean, results long", "Append", "ProcessingTime")


class _Budget(StatefulProcessor):
    """Addresses seen of a domain, each for its life time; their number is the budget that is used."""

    def __init__(self, most: int, ttl: float) -> None:
        self.most, self.ttl = most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "url string", "ord long", round(self.ttl * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values("ord")
        have = {u[0] for u in self.seen.keys()}
        keep = []
        for o, u, c in zip(d["ord"], d["url"], d["crawl_url"]):
            if c not in have and len(have) < self.most:
                have.add(c)
                self.seen.updateValue((c,), (int(o),))
                keep.append((key[0], int(o), u))
        if keep:
            yield pd.DataFrame(keep, columns=["domain", "ord", "url"])

    def close(self) -> None:
        pass


def crawl_budget(pages: DataFrame, most: int = PAGES_A_DOMAIN, ttl: float = PAGE_TTL) -> DataFrame:
    """domain, ord, url of a stream's pages (ord, url) whose crawl address is new while their domain
    has fewer than so many live ones. An address is forgotten after its life time, and so is a
    domain without live addresses: the state holds at most `most` addresses of a domain."""
    d = pages.select(U.host(F.col("url")).alias("domain"), "ord", "url", U.crawl_canonical(F.col("url")).alias("crawl_url")).filter("domain IS NOT NULL")
    return d.groupBy("domain").transformWithStateInPandas(_Budget(most, ttl), "domain string, ord long, url string", "Append", "ProcessingTime")
