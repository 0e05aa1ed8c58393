"""Sharding along a Hilbert curve over several metadata dimensions.

Language, source and size of each document are quantised by share of rows: a value's cell is
where the middle of its rows stands among all rows in the order of values, so that no range
of values, however many rows it has or whatever its values begin with, crowds a few cells.
Sizes are first rounded to sixteenths of an octave. The curve's index of the three cells is
the sort key, and the sorted run is cut into shards whose row counts differ by one at most
(law `rows`). Neighbours on the curve are near each other in every dimension, so a file holds
a small box of each and a filter on any of them skips files. Only keys are sorted, no texts.
Positions come from one range-partitioned sort, written once: the row's place in its
partition plus the rows of the partitions before it.

Null text: size 1, checksum of no bytes. Very long texts: by size and checksum. Null
metadata: before all values. Equal texts of one language and source lie side by side, those
of others where their metadata puts them; ties go by checksum, size and doc_id (null first);
repeated rows have slots of their own. Further columns, also of clashing names, are passed
over. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadweave.llm.common import broadcast_if_small, materialize, pick, release

SHARDS, BITS = 16, 10


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points whose coordinates have so many bits.

    The transpose form of the curve: undo the excess rotations from the top bit down,
    then Gray-code, then interleave.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def size_class(size: Column) -> Column:
    """Sixteenths of an octave, as whole numbers that rise with the size (1 at least)."""
    octave = F.length(F.bin(size)) - 1
    scaled = F.when(octave >= 4, F.call_function("shiftright", size, F.greatest(octave - 4, F.lit(0)))).otherwise(F.call_function("shiftleft", size, F.greatest(4 - octave, F.lit(0))))
    return (octave * 16 + scaled - 16).cast("int")


def in_order(rows: DataFrame, *by: Column | str, weight: str | None = None, label: str = "order") -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """rows sorted and written, with part and place (in the order), one row of `before` for each
    part, the total, and the written table. The parts are those of the sort; before: rows, or
    weights, ahead of a part."""
    one = F.lit(1).cast("long") if weight is None else F.col(weight)
    ordered = materialize(rows.orderBy(*by).withColumn("place", F.monotonically_increasing_id()), label)
    ordered_ = ordered.withColumn("part", F.shiftright("place", 33).cast("long"))
    # one number for each partition of the sort: their count is bounded by the shuffle's
    sums = sorted(ordered_.groupBy("part").agg(F.sum(one)).collect())
    starts, total = [], 0
    for p, n in sums:
        starts.append((p, total))
        total += n
    return ordered_, rows.sparkSession.createDataFrame(starts or [(-1, 0)], "part long, before long"), total, ordered


def cells(keys: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """value, cell: the place of the middle of each value's rows among all rows."""
    counts = keys.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered, starts, total, table = in_order(counts, F.col("value").asc_nulls_first(), weight="n", label="shard-values")
    own = F.sum("n").over(Window.partitionBy("part").orderBy("place")) - F.col("n")
    at = ordered.withColumn("own", own).join(F.broadcast(starts), "part").withColumn("at", 2 * (F.col("before") + F.col("own")) + F.col("n"))
    out = materialize(at.select("value", F.expr(f"at * {1 << bits}L div {2 * max(1, total)}L").alias("cell")), "shard-cells")
    release(table)
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every row."""
    @F.pandas_udf("long")
    def curve(c0: pd.Series, c1: pd.Series, c2: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c0, c1, c2], axis=1), BITS))

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = pick(docs, "doc_id", "text", "lang", "source").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source")
    keys = materialize(keys.withColumn("class", size_class(F.col("size"))), "shard-keys")
    placed, made = keys, []
    for i, d in enumerate(("lang", "source", "class")):
        made.append(cells(keys, d))
        c = broadcast_if_small(made[-1]).withColumnRenamed("cell", f"c{i}")
        placed = placed.join(c, F.col(d).eqNullSafe(F.col("value"))).drop("value")
    placed = placed.select("doc_id", "size", "text_crc32", curve("c0", "c1", "c2").alias("curve"))
    ordered, starts, total, _ = in_order(placed, "curve", "text_crc32", "size", "doc_id", label="shard-order")
    at = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    out = ordered.join(F.broadcast(starts), "part").withColumn("position", F.col("before") + at)
    which = F.expr(f"position * {shards}L div {max(1, total)}L")
    out = out.withColumn("shard", which.cast("int"))
    first = F.expr(f"(CAST(shard AS LONG) * {total}L + {shards - 1}L) div {shards}L")
    release(keys, *made)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("position") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
