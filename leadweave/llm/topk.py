"""Exact top-k search by inner product with a vector-approximation file.

Components become integers. Equal vectors are one entry with its k + 1 smallest rows, which
is all that any query can need of them. The approximation file is written once: blocks of
entries as cells of one byte a component, with the edges of the cells in each dimension. Queries, a
stated set, come to the blocks in blocks of their own; no vector travels there.

The first scan of the cells gives, for each query and block, the largest lower bounds of the
inner product; the k-th of them over all blocks is the threshold. The second scan names the
entries whose upper bound reaches it. Only these are read exactly, in falling order of their
upper bounds: first as many as fill k rows, and then, of the others, those whose bound reaches
the k-th score found so far. With these the k-th result is certain.

Null vectors, vectors with null or non-finite components and rows without an id take no
part; empty vectors neither. A query and a vector of another length are not compared.
Equal scores: the smaller vec_id is first. Rows that repeat an id are rows of their own: each
is a candidate of the other, and, where the id is a query's, each has its own results. Very
long vectors: blocks hold fewer. Further columns, also of clashing names, are passed over.
Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadweave.llm.common import materialize, pick, release

K, QUERY_STEP, CELLS = 5, 50, 256
CELLS_A_BLOCK, COMPONENTS_A_QUERY_BLOCK = 1 << 20, 1 << 16  # components of the entries or queries of a block


def cell_edges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest integer of each cell (columns) in each dimension (rows)."""
    width = np.maximum(1, -(-(hi - lo + 1) // CELLS))
    low = lo[:, None] + width[:, None] * np.arange(CELLS)[None, :]
    return low, np.minimum(low + width[:, None] - 1, hi[:, None])


def bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries and cells."""
    d = np.arange(cells.shape[1])
    below, above = low[d, cells].astype(float), high[d, cells].astype(float)
    plus, minus = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    bottom, top = plus @ below.T + minus @ above.T, plus @ above.T + minus @ below.T
    largest = float(np.abs(q).max(initial=0)) * float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) * cells.shape[1]
    if largest >= 2**52:  # floats that large are rounded: widen the bounds
        slack = largest * cells.shape[1] * 2.0**-50
        bottom, top = bottom - slack, top + slack
    return bottom, top


def entries_of(vectors: DataFrame, k: int) -> DataFrame:
    """entry, dim, v, rows: each distinct vector with its k + 1 smallest rows (vec_id, rid)."""
    first = Window.partitionBy("v").orderBy("vec_id", "rid")
    few = vectors.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    e = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "rid"))).alias("rows"))
    return e.select(F.col("rows")[0]["rid"].alias("entry"), F.size("v").alias("dim"), "v", "rows")


def approximation_file(entries: DataFrame) -> DataFrame:
    """dim, block, entries, sizes, cells, low, high: the written cells of all entries."""
    ends = entries.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = ends.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "lo", "hi"))).alias("e"))  # dim numbers for each length
    count = entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("dim") / CELLS_A_BLOCK)).cast("int")
    ends = materialize(ends.join(count, "dim").select("dim", blocks.alias("blocks"), F.transform("e", lambda x: x["lo"]).alias("lo"), F.transform("e", lambda x: x["hi"]).alias("hi")), "va-ends")
    dealt = entries.join(ends.select("dim", "blocks"), "dim").select("dim", F.pmod(F.xxhash64("entry"), "blocks").cast("int").alias("block"), "entry", F.size("rows").alias("size"), "v")

    schema = pa.schema([("dim", pa.int32()), ("block", pa.int32()), *[(n, pa.binary()) for n in ("entries", "sizes", "cells", "low", "high")]])

    def pack(e: pa.Table, edge: pa.Table) -> pa.Table:
        if not e.num_rows:
            return schema.empty_table()
        dim = e.column("dim")[0].as_py()
        lo, hi = (np.array(edge.column(c)[0].as_py(), dtype=np.int64) for c in ("lo", "hi"))
        low, high = cell_edges(lo, hi)
        v = e.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        cells = ((v - lo) // (low[:, 1] - low[:, 0])).astype(np.uint8)
        sizes = e.column("size").to_numpy().astype(np.int32).tobytes()
        row = (dim, e.column("block")[0].as_py(), e.column("entry").to_numpy().astype(np.int64).tobytes(), sizes, cells.tobytes(), low.tobytes(), high.tobytes())
        return pa.Table.from_pylist([dict(zip(schema.names, row))], schema)

    # each block meets the one row of its length's edges
    edges = ends.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    va = dealt.groupBy("dim", "block").cogroup(edges.groupBy("dim", "block")).applyInArrow(pack, "dim int, block int, entries binary, sizes binary, cells binary, low binary, high binary")
    va = materialize(va, "va-file")
    release(ends)
    return va


def _query_blocks(queries: DataFrame, va: DataFrame) -> DataFrame:
    """dim, block and the queries of one block as bytes, for each block of the file."""
    n = queries.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("dim") / COMPONENTS_A_QUERY_BLOCK)).cast("int").alias("parts")
    dealt = queries.join(n.select("dim", parts), "dim").withColumn("part", F.pmod(F.xxhash64("rid"), "parts"))

    schema = pa.schema([("dim", pa.int32()), *[(n, pa.binary()) for n in ("rids", "own", "listed", "q", "least")]])

    def pack(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        raw = lambda x, kind: np.asarray(x, dtype=kind).tobytes()
        col = lambda n: t.column(n).to_numpy(zero_copy_only=False)
        row = (t.column("dim")[0].as_py(), raw(col("rid"), np.int64), raw(col("entry"), np.int64), raw(col("listed"), np.uint8), raw(v, np.int64), raw(col("least"), np.float64))
        return pa.Table.from_pylist([dict(zip(schema.names, row))], schema)

    packed_ = dealt.groupBy("dim", "part").applyInArrow(pack, "dim int, rids binary, own binary, listed binary, q binary, least binary")
    blocks = va.groupBy("dim").agg(F.max("block").alias("last"))
    return packed_.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), "last"))).drop("last")


def _scan(queries: DataFrame, va: DataFrame, k: int, name: bool) -> DataFrame:
    """rid and low (the k largest lower bounds in a block); or, by name, rid, entry and upper
    bound of all entries whose bound reaches the query's `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                entries, sizes = np.frombuffer(r["entries"], np.int64), np.frombuffer(r["sizes"], np.int32)
                low, high = (np.frombuffer(r[c], np.int64).reshape(r["dim"], CELLS) for c in ("low", "high"))
                cells, q = (np.frombuffer(r[c], t).reshape(-1, r["dim"]) for c, t in (("cells", np.uint8), ("q", np.int64)))
                rids, own, listed, least = (np.frombuffer(r[c], t) for c, t in (("rids", np.int64), ("own", np.int64), ("listed", np.uint8), ("least", np.float64)))
                for at in range(0, len(q), 64):
                    bottom, top = bounds(q[at : at + 64], cells, low, high)
                    # rows that an entry has for a query: not the query's own
                    many = sizes[None, :] - ((entries[None, :] == own[at : at + 64, None]) & (listed[at : at + 64, None] > 0))
                    if name:
                        i, j = np.nonzero((top >= least[at : at + 64, None]) & (many > 0))
                        yield pa.RecordBatch.from_arrays([pa.array(rids[at + i]), pa.array(entries[j]), pa.array(top[i, j])], names=["rid", "entry", "upper"])
                        continue
                    lows = []
                    for x, m in zip(bottom, many):
                        best = np.argpartition(-x, min(k, len(x) - 1))[: k + 1]  # one of them may have no row
                        lows.append(np.sort(np.repeat(x[best], m[best]))[::-1][:k])
                    yield pa.RecordBatch.from_arrays([pa.array(rids[at : at + 64]), pa.array(lows, pa.list_(pa.float64()))], names=["rid", "low"])

    pairs = _query_blocks(queries, va).join(va, ["dim", "block"])
    return pairs.mapInArrow(run, "rid long, entry long, upper double" if name else "rid long, low array<double>")


def _score(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; vectors: vec_id, rid (unique) and integers v, none null;
    queries: rows of vectors."""
    entries = materialize(entries_of(vectors, k), "va-entries")
    va = approximation_file(entries)
    own = F.exists("rows", lambda x: x["rid"] == F.col("rid")).alias("listed")
    queries = queries.join(entries.select("entry", "v", "rows"), "v").select("rid", "vec_id", "v", F.size("v").alias("dim"), "entry", own)
    queries = materialize(queries, "va-queries")

    lows = _scan(queries.withColumn("least", F.lit(0.0)), va, k, False)
    least = lows.groupBy("rid").agg(F.sort_array(F.flatten(F.collect_list("low")), asc=False).alias("low"))  # k numbers for each block
    least = materialize(least.select("rid", F.coalesce(F.get("low", F.lit(k - 1)), F.lit(float("-inf"))).alias("least")), "va-least")
    left = _scan(queries.join(least, "rid"), va, k, True)
    by_bound = Window.partitionBy("rid").orderBy(F.desc("upper"), "entry")
    left = materialize(left.withColumn("place", F.row_number().over(by_bound)), "va-left")

    def read(pairs: DataFrame) -> DataFrame:
        """rid, vec_id, score of the rows of these entries, the query's own left out."""
        e = entries.select("entry", F.col("v").alias("ev"), "rows")
        x = pairs.select("rid", "entry").join(e, "entry").join(queries.select("rid", "v"), "rid")
        x = x.select("rid", _score(F.col("v"), F.col("ev")).alias("score"), F.filter("rows", lambda r: r["rid"] != F.col("rid")).alias("rows"))
        return x.select("rid", "score", F.explode(F.slice("rows", 1, k)).alias("r")).select("rid", "score", F.col("r.vec_id").alias("vec_id"))

    first = materialize(read(left.filter(F.col("place") <= k)), "va-first")
    sure = first.groupBy("rid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # at most k * k
    sure = sure.select("rid", F.get("s", F.lit(k - 1)).alias("sure"))
    more = left.filter(F.col("place") > k).join(sure, "rid").filter(F.col("sure").isNull() | (F.col("upper") >= F.col("sure")))
    found = first.unionByName(read(more))
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = found.join(queries.select("rid", F.col("vec_id").alias("query_id")), "rid").select("query_id", "rank", "vec_id", "score")
    release(va, least)
    return out


def as_integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, rid and v = floor(256 * x) of each component, of the rows that take part; written."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    d = pick(embeddings, "vec_id", "embedding").withColumn("e", F.col("embedding").cast("array<double>"))
    d = d.filter(F.col("vec_id").isNotNull() & (F.size("e") > 0) & ~F.exists("e", bad))
    d = d.select("vec_id", F.transform("e", lambda x: F.floor(x * 256)).alias("v"))
    return materialize(d.withColumn("rid", F.monotonically_increasing_id()), "va-vectors")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = as_integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.filter(F.col("vec_id") % QUERY_STEP == 0))


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS rid, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

QUERIES = {"op6_topk": op6_topk}
ORACLES = {"op6_topk": ORACLE}
