"""The bucketed table: what a batch rewrites, crashes, repeats and the whole result."""

import pytest
from pyspark.sql import functions as F

from leadweave.operators import merge
from leadweave.sources import buckets as B

SCHEMA = "domain string, ord long, v string"


def last(batch, old):
    return merge.upsert(old if old is not None else batch.limit(0), batch, "domain", "ord")


def table(spark, path):
    return sorted(((r.domain, r.ord, r.v) for r in B.read_bucketed(spark, path).collect()), key=repr)


def test_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert B.read_bucketed(spark, path) is None
    rows = [(f"d{i}.com", i, "a") for i in range(60)] + [(None, 70, "n")]
    first = B.merge_bucketed(spark.createDataFrame(rows, SCHEMA), path, "domain", last, buckets=16, number=0)
    assert len(first) > 8 and table(spark, path) == sorted(rows, key=repr)
    before = B.manifest(spark, path)["buckets"]

    one = spark.createDataFrame([("d7.com", 100, "b")], SCHEMA)
    (touched,) = B.merge_bucketed(one, path, "domain", last, number=1)
    after = B.manifest(spark, path)["buckets"]
    assert {k for k in after if after[k] != before[k]} == {str(touched)} and len(after) == len(before)
    want = sorted([r for r in rows if r[0] != "d7.com"] + [("d7.com", 100, "b")], key=repr)
    assert table(spark, path) == want

    assert B.merge_bucketed(one, path, "domain", last, number=1) == []  # ran before
    two = spark.createDataFrame([("d8.com", 101, "c"), ("new.com", 102, "c")], SCHEMA)
    with monkeypatch.context() as m:  # a crash between write and swap
        m.setattr(B, "_swap", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            B.merge_bucketed(two, path, "domain", last, number=2)
    assert table(spark, path) == want and B.manifest(spark, path)["buckets"] == after
    assert len(list((tmp_path / "t" / "data").iterdir())) == 3

    B.merge_bucketed(two, path, "domain", last, number=2)
    want = sorted([r for r in want if r[0] != "d8.com"] + [("d8.com", 101, "c"), ("new.com", 102, "c")], key=repr)
    assert table(spark, path) == want and len(list((tmp_path / "t" / "data").iterdir())) == 3  # what was lost is swept
    for k in range(3, 6):
        B.merge_bucketed(spark.createDataFrame([("d9.com", 100 + k, str(k))], SCHEMA), path, "domain", last, number=k)
    assert len(B._versions(spark, path)) == B.KEEP and ("d9.com", 105, "5") in table(spark, path)
    assert B.merge_bucketed(one.limit(0), path, "domain", last, number=9) == []
    with pytest.raises(ValueError):
        B.merge_bucketed(spark.createDataFrame([("x.com", 1, "x")], SCHEMA), path, "domain", lambda b, o: b.union(spark.createDataFrame([(f"q{i}", 1, "q") for i in range(50)], SCHEMA)), number=10)
    assert table(spark, path) == sorted([r for r in want if r[0] != "d9.com"] + [("d9.com", 105, "5")], key=repr)


def test_other_writer(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([("a.com", 1, "a")], SCHEMA)
    B.merge_bucketed(d, path, "domain", last, buckets=4)
    with pytest.raises(RuntimeError):
        B._swap(spark, path, 0, {"buckets": {}})


def test_stream(spark, tmp_path):
    rows = [(f"d{i % 9}.com", i, str(i)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "t")
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second time there is nothing new
        q = B.merge_stream(s, path, "domain", last, str(tmp_path / "c"), buckets=4).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    want = {}
    for d, o, v in rows:
        want[d] = (d, o, v)
    assert table(spark, path) == sorted(want.values(), key=repr)
