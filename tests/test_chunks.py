"""Folds and windows in chunks against the plain loop, with one entity that owns most of the log."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadweave.operators import chunks
from leadweave.operators import telemetry as T


def log(n=3000, seed=5):
    r = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += r.choice([0, 1, 1, 30, 400])
        out.append((r.choice(["hot"] * 8 + ["a", "b", None]), i, t, r.random() < (0.97 if 500 < i < 2500 else 0.4), r.choice([0.4, 0.5, 0.8, 1.1, 1.0])))
    return out


SCHEMA = "e string, ord long, t long, failed boolean, a double"


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(log(), SCHEMA).repartition(7)


def of(rows, e):
    return [x for x in rows if x[0] == e]


@pytest.mark.parametrize("size,fan", [(1, 2), (50, 3), (1 << 18, 1 << 10)])
def test_folds(events, monkeypatch, size, fan):
    monkeypatch.setattr(chunks, "FAN", fan)
    d = F.when(F.col("failed"), -0.5).otherwise(0.5)
    add = {r.e: r for r in chunks.composed(events, "e", "ord", chunks.step(1.0, d, 1.0, 3.0), size).select("e", "n", chunks.applied(F.col("f"), F.lit(1.0)).alias("x")).collect()}
    lo, hi = F.when(F.col("a") < 0.6, 0.05).when(F.col("a") < 1, 0.1), F.when(F.col("a") > 1, 2.0)
    each = chunks.step(F.col("a"), 0.0, F.coalesce(lo, F.lit(-chunks.INF)), F.coalesce(hi, F.lit(chunks.INF)))
    mul = {r.e: r.x for r in chunks.composed(events, "e", "ord", each, size).select("e", chunks.applied(F.col("f"), F.lit(1.0)).alias("x")).collect()}
    assert len(add) == len(mul) == 4
    for e in add:
        x = y = 1.0
        for _, _, _, failed, a in of(log(), e):
            x = min(3.0, max(1.0, x + (-0.5 if failed else 0.5)))
            y = max(0.05, y * a) if a < 0.6 else max(0.1, y * a) if a < 1 else min(2.0, y * a) if a > 1 else y
        assert (add[e].x, add[e].n) == (x, len(of(log(), e))) and mul[e] == pytest.approx(y)


def test_fold_goes_on_from_yesterday(events):
    each = chunks.step(1.0, F.when(F.col("failed"), -7).otherwise(5), 0.0, 100.0)
    whole = chunks.composed(events, "e", "ord", each)
    two = chunks.merged(chunks.composed(events.filter("ord < 1400"), "e", "ord", each), chunks.composed(events.filter("ord >= 1400"), "e", "ord", each), "e")
    key = lambda d: sorted(((r.e, tuple(r.f), r.n) for r in d.collect()), key=repr)
    assert key(whole) == key(two)


def test_no_list_of_an_entity(events):
    """What one group of the fold gathers is a chunk, not the hot entity's log."""
    d = chunks.composed(events, "e", "ord", chunks.step(), 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_" in d and "part_" in d
    sizes = events.groupBy("e", chunks.chunk_of(F.col("ord"), 100)).count().agg(F.max("count")).first()[0]
    assert sizes <= 100 < len(of(log(), "hot"))


@pytest.mark.parametrize("n", [1, 2, 20, 50])
@pytest.mark.parametrize("size", [1, 500, 10**9])
def test_last_rows(events, n, size):
    d = chunks.with_last_rows(events, "e", ["t", "ord"], chunks.chunk_of(F.col("t"), size), n)
    w = Window.partitionBy("e", "chunk_").orderBy("t", "ord").rowsBetween(1 - n, 0)
    got = d.select("edge_", "ord", F.sum("a").over(w).alias("s"), F.count("a").over(w).alias("c")).filter("NOT edge_")
    plain = events.select("ord", F.sum("a").over(T.last_rows("e", ["t", "ord"], n)).alias("s"), F.count("a").over(T.last_rows("e", ["t", "ord"], n)).alias("c"))
    key = lambda d: sorted((r.ord, round(r.s, 9), r.c) for r in d.select("ord", "s", "c").collect())
    assert key(got) == key(plain)


def test_last_seconds(events):
    w = Window.partitionBy("e", "chunk_").orderBy("t").rangeBetween(-600, 0)
    want = sorted((r.ord, r.c) for r in events.select("ord", F.count("a").over(T.last_seconds("e", F.col("t"), 600)).alias("c")).collect())
    for size in (600, 7000):
        d = chunks.with_last_seconds(events, F.col("t"), 600, size)
        assert sorted((r.ord, r.c) for r in d.select("edge_", "ord", F.count("a").over(w).alias("c")).filter("NOT edge_").collect()) == want
    with pytest.raises(ValueError):
        chunks.with_last_seconds(events, F.col("t"), 600, 500)


@pytest.mark.parametrize("size", [1, 300, 10**9])
def test_streaks(events, size):
    got = chunks.failure_streak(events, "e", ["t", "ord"], F.col("failed"), chunks.chunk_of(F.col("t"), size))
    assert got.columns == [*events.columns, "streak"]
    want, run = {}, {}
    for e, o, _, failed, _ in log():
        run[e] = run.get(e, 0) + 1 if failed else 0
        want[o] = run[e]
    assert {r.ord: r.streak for r in got.collect()} == want and max(want.values()) > 20
    assert chunks.failure_streak(events.limit(0), "e", ["ord"], F.col("failed"), chunks.chunk_of(F.col("t"), size)).count() == 0
