"""Exact dedup: a minimal perfect hash over the digests of the historical rows.

Texts are normalised (each run of white space becomes one space) and named by their
SHA-256. Rows below a cut of doc_id are history: their distinct digests, grouped before
any shuffle, are dealt to buckets, and each bucket builds a minimal perfect hash whose
slots hold the full digest and the winner's doc_id. The digests of the newer rows,
grouped too, are looked up: a slot whose 32 bytes agree makes them repeats of its winner,
all others group among themselves. History holds the smaller ids, so winners are right.

Every shuffle but the last moves one row for each digest and map task, so a text that
a third of all rows share is one row a task; the last, which tells each row its group,
is a join that Spark splits where a digest is hot.

The index is a table: it can be written, kept and read again for newer rows (build_index,
look_up).

Null text counts as empty; all empty texts are one group. Very long texts: whole, by digest.
A null doc_id never wins over an id; if a group has only null ids, keep_id is null and one
row is kept. Of repeated rows (same id and text) one is kept and each has its own result row.
Ties: the smallest doc_id stays. Further columns, also of clashing names, are passed over.
Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm.common import SPACE, materialize, numbered, pick

DIGESTS_A_BUCKET = 20_000
MIN_BUCKETS = 64
GAMMA = 2.0  # bits of a level for each key that is left


def _mixed(d: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of 32-byte digests (rows of four words), another one for each level."""
    salt = (level + 1) * 0xD1B54A32D192ED03 % (1 << 64)
    x = d[:, 0] ^ (d[:, 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def build_mph(d: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Levels of bits, and the slot of each key; keys are distinct. Slots are 0..n-1.

    A key whose bit no other key of its level has stays there; the others go on to the
    next level. The slot is the rank of the bit over all levels.
    """
    left, levels, slots, base = np.arange(len(d)), [], np.zeros(len(d), dtype=np.int64), 0
    while len(left):
        if len(levels) > 200:
            raise ValueError("digests given to a minimal perfect hash are not distinct")
        m = max(64, int(GAMMA * len(left)) // 8 * 8)
        pos = (_mixed(d[left], len(levels)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(pos, minlength=m)[pos] == 1
        bits = np.zeros(m, dtype=bool)
        bits[pos[alone]] = True
        slots[left[alone]] = base + np.cumsum(bits)[pos[alone]] - 1
        base += int(alone.sum())
        left = left[~alone]
        levels.append(np.packbits(bits).tobytes())
    return levels, slots


def find_slots(levels: list[bytes], d: np.ndarray) -> np.ndarray:
    """The only slot that each digest can have, or -1; the caller compares the digests."""
    out, left, base = np.full(len(d), -1, dtype=np.int64), np.arange(len(d)), 0
    for k, raw in enumerate(levels):
        if not len(left):
            break
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).astype(bool)
        pos = (_mixed(d[left], k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[pos]
        out[left[hit]] = base + np.cumsum(bits)[pos[hit]] - 1
        base += int(bits.sum())
        left = left[~hit]
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    words = as_words(pdf["digest"])
    levels, slots = build_mph(words)
    by_slot = np.argsort(slots)
    return pd.DataFrame({
        "bucket": [pdf["bucket"].iloc[0]], "levels": [levels], "digests": [words[by_slot].tobytes()],
        "winners": [pdf["winner"].to_numpy(np.int64)[by_slot].tobytes()], "sizes": [pdf["n"].to_numpy(np.int64)[by_slot].tobytes()],
    })


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Decisions of one bucket: a row for each distinct digest."""
    digests, keep, known, size = list(new["digest"]), new["winner"].to_numpy(np.int64).copy(), new["known"].to_numpy(bool).copy(), new["n"].to_numpy(np.int64).copy()
    if not len(index):
        return pd.DataFrame({"digest": digests, "keep": keep, "known": known, "group_size": size})
    row = index.iloc[0]
    held = np.frombuffer(row["digests"], dtype="<u8").reshape(-1, 4)
    winners, sizes = np.frombuffer(row["winners"], dtype=np.int64), np.frombuffer(row["sizes"], dtype=np.int64).copy()
    own = np.ones(len(digests), dtype=bool)
    if digests:
        words = as_words(digests)
        at = find_slots(list(row["levels"]), words)
        own = (at < 0) | (held[at] != words).any(axis=1)  # byte check: the digest in the slot is the one asked for
        np.add.at(sizes, at[~own], size[~own])
    raw = row["digests"]
    return pd.DataFrame({
        "digest": [raw[32 * i : 32 * i + 32] for i in range(len(held))] + [d for d, o in zip(digests, own) if o],
        "keep": np.concatenate([winners, keep[own]]), "known": np.concatenate([np.ones(len(held), dtype=bool), known[own]]),
        "group_size": np.concatenate([sizes, size[own]]),
    })


INDEX = "bucket long, levels array<binary>, digests binary, winners binary, sizes binary"


def digests(docs: DataFrame) -> DataFrame:
    """digest, doc_id and n (rows with both) of the normalised texts."""
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    d = pick(docs, "doc_id", "text").select("doc_id", F.unhex(F.sha2(norm, 256)).alias("digest"))
    return d.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    g = rows.groupBy("digest").agg(F.min("doc_id").alias("w"), F.sum("n").alias("n"))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")
    return g.select(bucket, "digest", F.coalesce("w", F.lit(0)).alias("winner"), F.col("w").isNotNull().alias("known"), "n")


def build_index(history: DataFrame, buckets: int = MIN_BUCKETS) -> DataFrame:
    """One row for each bucket of the history's digests (digest, doc_id, n; no null ids):
    levels of bits, and by slot the digests, winners and group sizes. It can be written and
    read again; look_up needs the same number of buckets."""
    return _grouped(history, buckets).groupBy("bucket").applyInPandas(_build, INDEX)


def look_up(newer: DataFrame, index: DataFrame, buckets: int = MIN_BUCKETS) -> DataFrame:
    """digest, keep_id and group_size of every distinct digest of the index and of newer rows."""
    found = _grouped(newer, buckets).groupBy("bucket").cogroup(index.groupBy("bucket"))
    found = found.applyInPandas(_look_up, "digest binary, keep long, known boolean, group_size long")
    return found.select("digest", F.when(F.col("known"), F.col("keep")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, cut: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    cut: rows with a smaller doc_id are the history. Default: the middle of the ids.
    """
    d = materialize(digests(docs), "digests")
    lo, hi, count = d.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    if cut is None:
        cut = 0 if lo is None else (lo + hi) // 2 + 1
    buckets = max(MIN_BUCKETS, -(-count // DIGESTS_A_BUCKET))
    old = F.coalesce(F.col("doc_id") < F.lit(cut), F.lit(False))
    decided = look_up(d.filter(~old), build_index(d.filter(old), buckets), buckets)
    rows = numbered(d, "n", "copy").join(decided, "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {"op5_exact_dedup": ORACLE}
