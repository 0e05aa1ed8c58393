"""Embedding whitening: the covariance from an exact integer scatter, then its eigenvectors.

A component c becomes the integer x = floor(1024 * c) + 100000. SHIFT is subtracted, which a
covariance doesn't feel; each task adds up the shifted vectors and their products as integers
of any size and hands them on as limbs of 30 bits, which Spark adds up limb by limb. From the
n vectors' sums S and products the driver forms n * X'X - S * S' exactly; only that matrix,
divided by n * n, becomes a float matrix for eigh. Rows are centred exactly too (x less the
whole part of the mean, then its fraction) before they are projected.

Within a task, products are taken by float matrix multiplication where no sum can pass 2**53
(then it is exact), by 64-bit integers where no sum can pass 2**63, else by Python's integers.

Null vectors, vectors with null or non-finite entries, and such with an entry whose integer
is no long take no part. Vectors of one length are a fit list of their own (one n, one matrix);
an empty vector has no components, so no rows. Null vec_id: takes part, its rows carry the null.
Repeated rows and ids: each is a vector of its own. Ties between eigenvalues: the order that
eigh gives, the same for all rows. A component without variance (eigenvalue not above 2**-40
of the largest) has null for whitened and is left out of identity_error. A deviation beyond a
long is null in deviation, and whole in deviation_exact (decimal text). Very long vectors: the
matrix grows with the square of their length, on the driver too. Further columns, also of clashing names, are
passed over. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm.common import pick

SCALE, OFFSET = 1024, 100_000
SHIFT = OFFSET  # embeddings lie around zero, so their integers around OFFSET
COMPONENTS = 8
LIMB = 30  # bits: limbs of 2**32 tasks add up within a long
ROWS_A_PRODUCT = 8192
LEAST = 2.0**-40


def as_integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, of the rows that take part."""
    d = pick(embeddings, "vec_id", "embedding").withColumn("e", F.col("embedding").cast("array<double>"))
    limit = float(2**62 // SCALE)  # also tells infinities
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= limit)
    d = d.filter((F.size("e") > 0) & ~F.exists("e", bad))
    return d.select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def _by_length(b: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length in a batch."""
    lists = b.column(column)
    each = lists.value_lengths().to_numpy()
    flat, first = lists.flatten().to_numpy(), np.cumsum(each) - each
    for dim in np.unique(each):
        at = np.flatnonzero(each == dim)
        yield at, flat[first[at][:, None] + np.arange(dim)]


def products(y: np.ndarray) -> np.ndarray:
    """y'y of integers, exact, as 64-bit integers or, where those don't do, as Python's."""
    top = int(np.abs(y).max(initial=0))
    most = top * top * max(1, len(y))
    if most < 2**53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64)
    if most < 2**63:
        return y.T @ y
    o = y.astype(object)
    return o.T @ o


def limbs(v: int) -> list[int]:
    """Signed limbs of LIMB bits, the lowest first."""
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v:
        out.append(sign * (v & ((1 << LIMB) - 1)))
        v >>= LIMB
    return out


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, i, j, limb, value of a task's sums: of products (i <= j), of entries (i = -1), of rows (i = j = -1)."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for _, x in _by_length(b, "x"):
            y = np.hstack([np.ones((len(x), 1), dtype=np.int64), x - SHIFT])  # the constant's products are the sums
            for at in range(0, len(y), ROWS_A_PRODUCT):
                p = products(y[at : at + ROWS_A_PRODUCT]).astype(object)
                dim = x.shape[1]
                total[dim] = total[dim] + p if dim in total else p
    for dim, p in total.items():
        rows = [(dim, i - 1, j - 1, k, v) for i in range(dim + 1) for j in range(i, dim + 1) for k, v in enumerate(limbs(int(p[i, j])))]
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["dim", "i", "j", "limb", "value"])


@dataclass
class Whitening:
    """Of vectors of one length: n, the whole part of their mean and its rest as integers over
    n, unit eigenvectors (columns) with their eigenvalues, falling, and the scatter's trace."""

    n: int
    whole: list[int]
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def usable(self) -> np.ndarray:
        return self.values > LEAST * max(float(self.values[0]), 0.0)


def decompose(n: int, sums: list[int], cross: list[list[int]], components: int = COMPONENTS) -> Whitening:
    """From exact sums and products (shifted) to eigenvectors; floats begin after the subtraction."""
    d = len(sums)
    exact = [[n * cross[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    v = np.array([[e / (n * n) for e in row] for row in exact])  # each rounded once
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    whole = [(2 * s + n) // (2 * n) for s in sums]
    out = Whitening(n, [w + SHIFT for w in whole], [s - n * w for s, w in zip(sums, whole)], vectors, values, sum(exact[i][i] for i in range(d)) / (n * n), 0.0)
    w = vectors[:, out.usable] / np.sqrt(values[out.usable])
    out.identity_error = float(np.abs(w.T @ v @ w - np.eye(w.shape[1])).max(initial=0.0))
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of vectors. The driver gets a few limbs for each entry of a matrix."""
    parts = vectors.mapInArrow(_scatter, "dim int, i int, j int, limb int, value long")
    cells: dict[int, dict[tuple[int, int], int]] = {}
    for r in parts.groupBy("dim", "i", "j", "limb").agg(F.sum("value").alias("value")).collect():
        c = cells.setdefault(r.dim, {})
        c[r.i, r.j] = c.get((r.i, r.j), 0) + (r.value << (LIMB * r.limb))
    models = {}
    for dim, c in cells.items():
        at = lambda i, j, c=c: c.get((min(i, j), max(i, j)), 0)
        models[dim] = decompose(at(-1, -1), [at(-1, i) for i in range(dim)], [[at(i, j) for j in range(dim)] for i in range(dim)], components)
    return models


def deviations(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Sum over dimensions of (n * x - S)**2 of each row, exact (integers of 64 bits or Python's)."""
    whole, rest = np.array(model.whole, dtype=np.int64), np.array(model.rest, dtype=np.int64)
    y = x - whole
    most = model.n * (int(np.abs(y).max(initial=0)) + 1)
    u = model.n * y - rest if most * most * x.shape[1] < 2**63 else model.n * y.astype(object) - rest.astype(object)
    return (u * u).sum(axis=1)


def whiten(vectors: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_length(b, "x"):
                m = models[x.shape[1]]
                k, rows = len(m.values), len(at)
                centred = (x - np.array(m.whole, dtype=np.int64)).astype(float) - np.array([r / m.n for r in m.rest])
                with np.errstate(divide="ignore", invalid="ignore"):
                    z = (centred @ m.vectors) / np.sqrt(np.maximum(m.values, 0))
                dev = [int(v) for v in deviations(x, m)]
                owner = np.repeat(np.arange(rows), k)
                cols = [
                    b.column("vec_id").take(pa.array(at[owner])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, m.n, dtype=np.int64)),
                    pa.array([v if v < 2**63 else None for v in dev], pa.int64()).take(pa.array(owner)),
                    pa.array(z.ravel(), mask=~np.tile(m.usable, rows)),
                    pa.array(np.tile(m.values / m.trace if m.trace else np.zeros(k), rows)),
                    pa.array(np.full(rows * k, m.identity_error)),
                    pa.array([str(v) for v in dev]).take(pa.array(owner)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return vectors.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = as_integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whiten(v, fit(v))


QUERIES = {"op13_whitening": op13_whitening}
#: SQL has no eigenvectors.
ORACLES: dict[str, str] = {}
