"""A table in hash buckets with a manifest: a batch rewrites the buckets that it touches.

path/manifests/<version> is a small JSON file: bucket to folder, schema, last batch. It is written
whole and renamed last, so a reader sees the table before or after a batch, never between, and a
crash before the rename changes nothing. Folders that the last KEEP manifests don't name are swept
after the swap. One writer at a time; the rename fails if another one was faster.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.sources.readers import _fs

BUCKETS, KEEP = 256, 2


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, f"{path}/manifests")
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.isdigit()) if fs.exists(p) else []


def _manifest(spark: SparkSession, path: str, version: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/manifests/{version}", wholetext=True).collect()))


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The current manifest, or None before the first batch."""
    have = _versions(spark, path)
    return _manifest(spark, path, have[-1]) if have else None


def _swap(spark: SparkSession, path: str, version: int, content: dict) -> None:
    fs, p = _fs(spark, f"{path}/manifests")
    fs.mkdirs(p)
    made = _path(spark, path, "manifests", f"new-{uuid.uuid4().hex}")
    out = fs.create(made)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    target = _path(spark, path, "manifests", f"{version:020d}")
    if fs.exists(target) or not fs.rename(made, target):
        raise RuntimeError(f"another writer has made version {version} of {path}")


def _sweep(spark: SparkSession, path: str) -> None:
    """Deletes old manifests, and data that no kept manifest names."""
    fs, data = _fs(spark, f"{path}/data")
    have = _versions(spark, path)
    used = {d for v in have[-KEEP:] for d in _manifest(spark, path, v)["buckets"].values()}
    for v in have[:-KEEP]:
        fs.delete(_path(spark, path, "manifests", v), False)
    for s in fs.listStatus(data):
        run = s.getPath().getName()
        for b in fs.listStatus(s.getPath()):
            if b.isDirectory() and f"{run}/{b.getPath().getName()}" not in used:
                fs.delete(b.getPath(), True)
        if not any(u.startswith(run + "/") for u in used):
            fs.delete(s.getPath(), True)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_bucketed(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame | None:
    """The table, or some buckets of it; None before the first batch."""
    m = manifest(spark, path)
    if m is None:
        return None
    dirs = [f"{path}/data/{d}" for b, d in m["buckets"].items() if only is None or int(b) in only]
    return spark.read.schema(m["schema"]).parquet(*dirs) if dirs else spark.createDataFrame([], m["schema"])


def merge_bucketed(batch: DataFrame, path: str, key: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame], batch_key: Column | None = None, buckets: int = BUCKETS, number: int | None = None) -> list[int]:
    """Merges a batch into the table: merge(batch, old rows of the touched buckets or None) gives
    their new rows, by `key`; batch_key: the key as an expression over the batch, where it differs.
    A batch whose number was merged before is passed over. Returns the buckets rewritten. The
    number of buckets is that of the first batch."""
    spark = batch.sparkSession
    m = manifest(spark, path)
    if m is not None and number is not None and m["batch"] is not None and number <= m["batch"]:
        return []
    n = m["count"] if m else buckets
    at = bucket_of(F.col(key) if batch_key is None else batch_key, n)
    touched = sorted(r[0] for r in batch.select(at.alias("b")).distinct().collect())  # at most `buckets` numbers
    if m is not None and not touched:
        return []
    old = read_bucketed(spark, path, touched) if m else None
    out = merge(batch, old)
    run = uuid.uuid4().hex
    b = out.withColumn("_bucket", bucket_of(F.col(key), n))
    b.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/data/{run}")
    fs, p = _fs(spark, f"{path}/data/{run}")
    new = {x.getPath().getName().split("=")[1]: f"{run}/{x.getPath().getName()}" for x in fs.listStatus(p) if x.isDirectory()}
    stray = sorted(set(map(int, new)) - set(touched))
    if stray:
        raise ValueError(f"merged rows fall into buckets {stray} that the batch doesn't touch: batch_key must be the rows' {key}")
    kept = {k: d for k, d in (m["buckets"] if m else {}).items() if int(k) not in touched}
    have = _versions(spark, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    _swap(spark, path, int(have[-1]) + 1 if have else 0, {"count": n, "batch": number if number is not None else m and m["batch"], "schema": schema, "buckets": {**kept, **new}})
    _sweep(spark, path)
    return touched


def merge_stream(stream: DataFrame, path: str, key: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame], checkpoint: str, batch_key: Column | None = None, buckets: int = BUCKETS):
    """Merges every micro-batch into such a table; one that ran before isn't merged twice."""

    def one(batch: DataFrame, number: int) -> None:
        merge_bucketed(batch, path, key, merge, batch_key, buckets, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
