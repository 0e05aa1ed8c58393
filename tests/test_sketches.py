"""Kept reports: merged snapshots against one over all rows, and against exact values."""

import random

import pytest
from pyspark.sql import functions as F

from leadweave.operators import sketches as S


@pytest.fixture(scope="module")
def log(spark):
    r = random.Random(4)
    rows = [("hot", r.lognormvariate(5, 1), r.randrange(9000), r.random() < 0.2) for _ in range(40_000)]
    rows += [(f"e{i % 7}", float(i), i % 5, i % 2 == 0) for i in range(700)] + [("silent", None, None, False), ("nan", float("nan"), 1, True), (None, 5.0, 2, True)]
    return spark.createDataFrame(rows, "e string, ms double, v int, failed boolean").repartition(5).cache()


def shot(d):
    return S.snapshot(d, "e", "ms", "v", failed=F.col("failed"))


def test_merged_equals_one_over_all(spark, log, tmp_path):
    part = F.pmod(F.xxhash64("e", "ms", "v"), F.lit(3))
    for i in range(3):  # as kept between runs
        shot(log.filter(part == i)).write.parquet(str(tmp_path / str(i)))
    kept = [spark.read.parquet(str(tmp_path / str(i))) for i in (2, 0, 1)]
    got = {r.e: r for r in S.report(S.merged("e", S.merged("e", *kept[:2]), kept[2]), "e").collect()}
    want = {r.e: r for r in S.report(shot(log), "e").collect()}
    assert set(got) == set(want) == {"hot", "silent", "nan", None, *[f"e{i}" for i in range(7)]}
    for e in got:
        assert (got[e].requests, got[e].failed_rate) == (want[e].requests, want[e].failed_rate)
        assert got[e].avg_latency == pytest.approx(want[e].avg_latency, rel=1e-12)
        if e != "hot":  # few samples: exact
            assert tuple(got[e])[4:] == tuple(want[e])[4:]
    assert (got["silent"].median_latency, got["nan"].p95_latency, got["silent"].distinct_values) == (0.0, 0.0, 0)
    ms = sorted(r.ms for r in log.filter("e = 'hot'").select("ms").collect())
    for q, x in ((0.5, got["hot"].median_latency), (0.95, got["hot"].p95_latency)):
        rank = sum(m <= x * 1000 for m in ms) / len(ms)
        assert abs(rank - q) <= S.RANK_ERROR
    exact = log.filter("e = 'hot'").select("v").distinct().count()
    assert abs(got["hot"].distinct_values - exact) <= 3 * S.DISTINCT_ERROR * exact


def test_nothing(log):
    none = shot(log.limit(0))
    assert S.report(S.merged("e", none, none), "e").count() == 0
    assert S.report(S.merged("e", none, shot(log)), "e").count() == 11
