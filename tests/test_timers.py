"""Machines with timers against the plain loop, caches and budgets whose state runs out."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leadweave.operators import telemetry as T
from leadweave.streaming import timers as S

MACHINES = [S.ScoredBreaker(4.0, 10.0, 60.0), S.RatioBreaker(waits=(20.0, 40.0, 80.0)), S.StreakBreaker(3, 50.0, True), S.StreakBreaker(3, 50.0), S.Quarantine((5.0, 10.0, 20.0))]
LOG = "entity string, ord long, ts timestamp, failed boolean"


def log(n=300):
    r = random.Random(8)
    t, out = 1000.0, []
    for i in range(n):
        t += r.choice([0, 1, 2, 5, 25])
        out.append((r.choice("ab"), i, t, r.random() < (0.9 if i // 40 % 2 else 0.2)))
    return out


def parts(spark, path, rows, many, schema, cols):
    """Files of a stream, one a trigger, in order of time."""
    size = -(-len(rows) // many)
    for k in range(many):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).selectExpr(*cols).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return stream.sparkSession.table(name).collect()


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("at", range(len(MACHINES)))
def test_stream_equals_loop(spark, tmp_path, at):
    """The last event only moves the watermark: what is open then opens by its timer."""
    m, rows = MACHINES[at], log()
    last = rows[-1][2] + 1000
    s = parts(spark, str(tmp_path / "in"), [*rows, ("z", 10_000, last, False)], 4, "entity string, ord long, t double, failed boolean", ["entity", "ord", "timestamp_micros(cast(t * 1000000 as long)) ts", "failed"])
    got = [r for r in run(S.timed(s, m, "0 seconds"), f"timed{at}", "update", tmp_path) if r.entity != "z"]
    for e in "ab":
        state, want = S.moves(m, m.start(), [(t, f) for x, _, t, f in rows if x == e], last)
        mine = [r for r in got if r.entity == e]
        assert [(r.t, r.state) for r in mine] == want and len(want) > 5
        assert m.due(state) is None
        assert want[-1][1] != "OPEN" and mine[-1].t <= last


def test_machines_equal_batch(spark):
    d = spark.createDataFrame([(e, o, t, f) for e, o, t, f in log()], "k string, ord long, t double, failed boolean")
    of = lambda m, e: S.moves(m, m.start(), [(t, f) for x, _, t, f in log() if x == e])[0]
    for r in T.breaker_states(d, "k", "ord", F.col("t"), F.col("failed"), 4.0, 10.0, 60).collect():
        s = of(MACHINES[0], r.k)
        assert (r.state, r.points, r.trips) == (s[0], s[1], s[3])
    for r in T.ratio_breaker(d, "k", "ord", F.col("t"), F.col("failed"), waits=(20, 40, 80)).collect():
        s = of(MACHINES[1], r.k)
        assert (r.opens, r.backoff) == (s[4], s[3])
    for restart, m in ((True, MACHINES[2]), (False, MACHINES[3])):
        for r in T.streak_breaker(d, "k", "ord", F.col("t"), F.col("failed"), 3, 50.0, restart).collect():
            s = of(m, r.k)
            assert (r.opens, r.skipped) == (s[3], s[4])


def test_quarantine_gets_longer():
    m = S.Quarantine()
    s, out = S.moves(m, m.start(), [(0.0, True), (10.0, True), (31.0, True), (95.0, True), (300.0, True), (700.0, False), (701.0, True)], 1000.0)
    assert out == [(0.0, "OUT"), (30.0, "FREE"), (31.0, "OUT"), (91.0, "FREE"), (95.0, "OUT"), (215.0, "FREE"), (300.0, "OUT"), (600.0, "FREE"), (701.0, "OUT"), (731.0, "FREE")] and s[0] == "FREE"


def later(spark, tmp_path, make, files, pause):
    """Runs a query over the first files, waits, then over the last one, from the same checkpoint."""
    out = []
    for k, rows in enumerate(files):
        if k == len(files) - 1:
            time.sleep(pause)  # past the life time of what was kept
        spark.createDataFrame(rows[1:], rows[0]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(rows[0]).parquet(str(tmp_path / "in"))
        q = make(s).writeStream.foreachBatch(lambda b, _: out.append(sorted(map(tuple, b.collect())))).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()  # a clock that moves by itself never runs out of batches
        assert q.awaitTermination(60)
    return out


def test_cache_runs_out(spark, tmp_path):
    schema = "key string, ord long, results long"
    got = later(spark, tmp_path, lambda s: S.cached_answers(s, 3600, 3), [[schema, ("a", 1, 5), ("a", 2, 9), ("e", 1, 0), ("e", 2, 7), ("n", 1, None)], [schema, ("a", 3, 8), ("e", 3, 0), ("n", 2, None)], [schema, ("a", 4, 6), ("e", 4, 4), ("n", 3, 2)]], 5)
    batches = [x for x in got if x]
    assert batches[0] == [("a", 1, False, 5), ("a", 2, True, 5), ("e", 1, False, 0), ("e", 2, True, 0), ("n", 1, False, 0)]
    assert batches[-1] == [("a", 4, True, 5), ("e", 4, False, 4), ("n", 3, False, 2)]  # empty answers are forgotten sooner


def test_budget_runs_out(spark, tmp_path):
    schema = "ord long, url string"
    got = later(spark, tmp_path, lambda s: S.crawl_budget(s, 2, 4), [[schema, (1, "https://a.com/x"), (2, "http://www.a.com/x/"), (3, "https://a.com/y"), (4, "https://a.com/z"), (5, "https://b.com/"), (6, None)], [schema, (7, "https://a.com/w")]], 6)
    batches = [x for x in got if x]
    assert batches[0] == [("a.com", 1, "https://a.com/x"), ("a.com", 3, "https://a.com/y"), ("b.com", 5, "https://b.com/")]
    assert batches[-1] == [("a.com", 7, "https://a.com/w")]
