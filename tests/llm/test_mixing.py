"""Mixing: targets against a plain sharing loop, rounding against its own laws."""

import random
import re
import time

from pyspark.sql import functions as F

from leadweave.llm.mixing import _round_block, mix, source_targets


def shared(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()) * share, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > most * sizes[s]}
        if not over:
            return t | {s: most * sizes[s] for s in full}
        full |= over


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 400, None: 30, "é": 5, "Z": 0}, {"a": 7}, {"x": 0, "y": 0}, {str(i): 3**i for i in range(9)}):
        t = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in source_targets(t).collect()}
        want = shared(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 37 % 400), f"s{i % 4}" if i % 3 else None) for i in range(1500)]
    rows += [(2000, None, "s1"), (2001, "", None), (2002, "only", "lonely"), (None, "a b", "s2"), (2003, "a b", "s2"), (2003, "a b", "s2"), (2004, "long " * 20000, "s3")]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, TEXT string").repartition(5)
    got = mix(d).collect()
    assert len(got) == len(rows)
    sources = {}
    for _, t, s in rows:
        sources[s] = sources.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, largest = shared(sources), {}
    taken = dict.fromkeys(sources, 0)
    for r in got:
        assert 0 <= r.copies <= 2 and r.source_size == sources[r.source]
        taken[r.source] += r.copies * r.size
    for s in sources:
        assert abs(taken[s] - want[s]) <= max(1, 0.02 * want[s]), (s, taken[s], want[s])
    again = mix(d.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix(d.limit(0)).count() == 0


def test_equal_rows_are_dealt(spark):
    """Rows that nothing tells apart share no block; time grows with their number."""
    took = []
    for n in (10_000, 100_000):
        d = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source")).union(spark.createDataFrame([(1, "x y " * 50, "t")], "doc_id long, text string, source string"))
        start = time.perf_counter()
        got = {r.copies: r["count"] for r in mix(d).filter("source = 's'").groupBy("copies").count().collect()}
        took.append(time.perf_counter() - start)
        total = 3 * n + 100
        want = 2 * 100 if total * 1.5 / 4 > 200 else total * 1.5 / 4
        assert sum(got.values()) == n and abs(3 * sum(c * k for c, k in got.items()) - (1.5 * total - want)) <= 6
    assert took[1] < 10 * took[0] + 5


def test_pairwise_transfers_of_a_block(spark):
    """One block by a plain loop: the same mass, all but one item integral, largest first."""
    r = random.Random(3)
    for _ in range(20):
        items = sorted(((r.randint(1, 50), r.randrange(10**6), i, 1, i, 1, 0.0) for i in range(r.randint(1, 60))), reverse=True)
        rate = r.random()
        items = [(*x[:6], rate * x[0]) for x in items]
        d = spark.createDataFrame([(items,)], "items array<struct<size:bigint,h:bigint,doc_id:bigint,base:int,key:bigint,rows:bigint,m:double>>")
        out = d.select(_round_block(F.col("items"), 0).alias("o")).first().o
        assert [x.doc_id for x in out] == [x[2] for x in items]
        left = [x for x in out if x.extra is None]
        assert len(left) <= 1 and all(x.m == (x.size if x.extra else 0) for x in out if x.extra is not None)
        assert abs(sum(x.m for x in out) - rate * sum(x[0] for x in items)) < 1e-6
        assert all(0 < x.m < x.size for x in left)


def test_fractions_are_kept_on_average(spark):
    """Over many blocks, a document of any size is taken as often as its fraction says."""
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    for r in mix(d).groupBy("source", "size").agg(F.avg("copies").alias("c"), F.first(F.col("target") / F.col("source_size")).alias("f")).collect():
        assert abs(r.c - r.f) < 0.06
