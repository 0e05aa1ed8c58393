"""Substring dedup by super-k-mers: windows of words that another document has before.

Consecutive windows of a document that share a minimiser (the smallest hash of its
grams) travel as one packed string to the bucket of that minimiser. There the windows of
all strings are sorted, equal ones are compared byte by byte, and each window learns the
smallest document it starts in. Every word under a window that a smaller document also
has goes; what goes is judged on the input alone.

What needn't travel doesn't: of documents with the same words only the smallest is
searched (the others go as a whole); minimisers that one document alone has are dropped
after a count; equal strings of one batch are settled there but for the smallest document.
The windows of a minimiser with more than HOT strings are dealt one by one, by a 128-bit
digest of each, to as many buckets as they need; there equal digests stand for equal
windows. A window that many documents have goes out once for each task and smaller document
that the task meets, so no bucket grows with the largest group of documents.

Null or empty text: no words. Texts with fewer words than a window stay as they are. Very
long texts: whole; one text is held in memory at a time beside its own runs. A null doc_id
counts as larger than any id. Rows with the same id don't remove each other's words. Ties:
the smallest doc_id keeps a window. Repeated rows give equal results. Further columns, also of
clashing names, are passed over. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm.common import batch_slices, give_back, materialize, pick, release
from leadweave.llm.words import gram_hashes, rolling_hashes, sliding_min, words

WINDOW, GRAM = 50, 10
HOT, RUNS_A_BUCKET, WINDOWS_A_BUCKET, MIN_BUCKETS = 250, 1000, 50_000, 256
KNOWN_WINDOWS = 500_000  # digests that a task remembers; beyond, it starts again
NO_ID = (1 << 63) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def super_kmers(h: np.ndarray, first: np.ndarray, count: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of windows with one minimiser: minimiser, text, start (word of the text), windows.

    h: hashes of all words; first, count: each text's first word and number of words.
    """
    low = sliding_min(gram_hashes(h, gram), window - gram + 1)
    own = np.maximum(count - window + 1, 0)
    text = np.repeat(np.arange(len(first)), own)
    at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    value = low[first[text] + at] if len(text) else np.zeros(0, dtype=np.uint64)
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])]) if len(text) else np.zeros(0, dtype=np.int64)
    return value[new].view(np.int64), text[new], at[new], np.diff(np.r_[new, len(text)])


def _slices(b: pa.RecordBatch, texts: int, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Rows from, to: so that the texts of a part have about this size."""
    long, start, total = pc.binary_length(b.column(texts)).fill_null(0).to_pylist(), 0, 0
    for i, n in enumerate(long):
        total += n + 1
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(long):
        yield start, len(long)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, digest and super-k-mers of each row (id, d, key, text)."""
    for b in batches:
        for lo, hi in _slices(b, 3):
            part = b.slice(lo, hi - lo)
            raw = [t or b"" for t in part.column(3).cast(pa.binary()).to_pylist()]
            split = [t.split() for t in raw]
            count = np.array([len(s) for s in split], dtype=np.int64)
            sha = [hashlib.sha256(b" ".join(s)).digest() for s in split]
            _, _, h = words(b"\n".join(raw))
            value, text, at, n = super_kmers(h, np.cumsum(count) - count, count)
            cut = np.searchsorted(text, np.arange(len(raw) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (value, at.astype(np.int32), n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(count), pa.array(sha, pa.binary()), *lists], names=["doc_id", "d", "key", "n_words", "sha", "low", "at", "n"])


def _packed(buckets: int, hot_buckets: int):
    """Rows (d, key, text, runs) to what travels: kind 0 strings, 1 windows' digests, 2 spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_hot: dict[bytes, int] = {}
        for b in batches:
            for lo, hi in _slices(b, 2, 8 << 20):
                part = b.slice(lo, hi - lo)
                if len(seen_hot) > KNOWN_WINDOWS:
                    seen_hot.clear()
                d, key = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts, runs = part.column(2).cast(pa.binary()).to_pylist(), part.column(3).to_pylist()
                out, seen = [], {}
                hot: dict[int, tuple[list, list, list, list]] = defaultdict(lambda: ([], [], [], []))
                for i in sorted(range(len(d)), key=lambda i: d[i]):  # the smallest document of a batch first
                    w, spans = texts[i].split(), []
                    for r in runs[i]:
                        start, n = r["at"], r["n"]
                        if not r["hot"]:
                            s = b" ".join(w[start : start + n + WINDOW - 1])
                            if seen.setdefault(s, d[i]) < d[i]:
                                spans += (start, start + n + WINDOW - 1)
                            else:
                                out.append((r["low"] % buckets, 0, d[i], key[i], start, n, s))
                            continue
                        for at in range(start, start + n):
                            g = hashlib.blake2b(b" ".join(w[at : at + WINDOW]), digest_size=16).digest()
                            least = seen_hot.get(g)
                            if least is not None and least < d[i]:
                                spans += (at, at + WINDOW)
                            else:
                                seen_hot[g] = d[i]
                                h = hot[int.from_bytes(g[:4], "little") % hot_buckets]
                                h[0].append(g)
                                h[1].append(d[i])
                                h[2].append(key[i])
                                h[3].append(at)
                    if spans:
                        out.append((key[i] % buckets, 2, d[i], key[i], 0, 0, merged(np.array(spans, dtype=np.int32).reshape(-1, 2)).tobytes()))
                for k, (g, ds, ks, ats) in hot.items():
                    out.append((buckets + k, 1, 0, 0, 0, len(g), b"".join(g) + np.array([*ds, *ks, *ats], dtype=np.int64).tobytes()))
                for s in range(0, len(out), 4000):
                    cols = list(zip(*out[s : s + 4000]))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "kind", "d", "key", "at", "n", "data"])
        seen_hot.clear()
        give_back()

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans as disjoint ones in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > top[:-1]]
    return np.stack([spans[new, 0], top[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]], axis=1).astype(np.int32)


def repeated(h: np.ndarray, d: np.ndarray, same) -> np.ndarray:
    """Which items have an equal one in a smaller document. same(i, j): are they equal?"""
    order = np.lexsort((d, h))
    head = np.maximum.accumulate(np.where(np.r_[True, h[order][1:] != h[order][:-1]], np.arange(len(order)), 0)) if len(order) else order
    out = np.zeros(len(h), dtype=bool)
    for i, j in zip(order[d[order] > d[order[head]]].tolist(), order[head[d[order] > d[order[head]]]].tolist()):
        if same(i, j):
            out[i] = True
        else:  # two texts with one hash: look at all of the group
            out[i] = any(same(i, k) for k in np.flatnonzero((h == h[i]) & (d < d[i])))
    return out


def _count(t: pa.Table) -> pa.Table:
    """Spans that go, by document, from all that reached one bucket."""
    kind = t.column("kind").to_numpy()
    d, key, at, n = (t.column(c).to_numpy() for c in ("d", "key", "at", "n"))
    data = t.column("data").to_pylist()
    docs, keys, starts, out_spans = [], [], [], []
    run = np.flatnonzero(kind == 0)
    if len(run):
        blob = b"\n".join([data[i] for i in run])
        begin, end, h = words(blob)
        n_run = n[run].astype(np.int64)
        first = np.cumsum(n_run + WINDOW - 1) - (n_run + WINDOW - 1)
        inner = np.arange(n_run.sum()) - np.repeat(np.cumsum(n_run) - n_run, n_run)
        place, owner = np.repeat(first, n_run) + inner, np.repeat(run, n_run)
        lo, hi = begin[place], end[place + WINDOW - 1]
        gone = repeated(rolling_hashes(h, WINDOW)[place], d[owner], lambda i, j: blob[lo[i] : hi[i]] == blob[lo[j] : hi[j]])
        docs.append(d[owner][gone])
        keys.append(key[owner][gone])
        starts.append(at[owner][gone] + inner[gone])
    hot = np.flatnonzero(kind == 1)
    if len(hot):
        g = b"".join([data[i][: 16 * n[i]] for i in hot])
        rest = [np.frombuffer(data[i][16 * n[i] :], dtype=np.int64).reshape(3, -1) for i in hot]
        hd, hk, ha = np.concatenate(rest, axis=1)
        gone = repeated(np.frombuffer(g, dtype="<u8")[::2], hd, lambda i, j: g[16 * i : 16 * i + 16] == g[16 * j : 16 * j + 16])
        docs.append(hd[gone])
        keys.append(hk[gone])
        starts.append(ha[gone])
    ds, ks, spans = [], [], []
    if docs:
        dd, kk, ss = np.concatenate(docs), np.concatenate(keys), np.concatenate(starts).astype(np.int64)
        order = np.lexsort((ss, kk, dd))
        dd, kk, ss = dd[order], kk[order], ss[order]
        cut = np.flatnonzero(np.r_[True, (dd[1:] != dd[:-1]) | (kk[1:] != kk[:-1])]) if len(dd) else []
        for a, z in zip(cut, np.r_[cut[1:], len(dd)].astype(int) if len(dd) else []):
            ds.append(int(dd[a]))
            ks.append(int(kk[a]))
            spans.append(merged(np.stack([ss[a:z], ss[a:z] + WINDOW], axis=1)).tobytes())
    for i in np.flatnonzero(kind == 2):
        ds.append(int(d[i]))
        ks.append(int(key[i]))
        spans.append(data[i])
    return pa.table({"d": pa.array(ds, pa.int64()), "key": pa.array(ks, pa.int64()), "spans": pa.array(spans, pa.binary())})


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, key, text, list of spans) to words removed and the text that is kept."""
    for b in batch_slices(batches, 2):
        n_removed, kept = [], []
        for text, spans in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
            w, out, at, gone = text.split(), [], 0, 0
            for lo, hi in merged(np.frombuffer(b"".join(spans), dtype=np.int32).reshape(-1, 2)).tolist():
                out += w[at:lo]
                at, gone = hi, gone + hi - lo
            out += w[at:]
            n_removed.append(gone)
            kept.append(b" ".join(out))
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha)], names=["d", "key", "removed", "kept_text", "kept_sha"])


def substring_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; kept_text where words went."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("key"), text.alias("text"))
    seen = rows.mapInArrow(_survey, "doc_id long, d long, key long, n_words long, sha binary, low array<long>, at array<int>, n array<int>")
    seen = materialize(seen, "survey")
    small = seen.select("doc_id", "d", "key", "n_words", "sha")
    # written first: a join with two exchanges of its own is one that Spark can split at a hot key
    least = materialize(small.groupBy("sha").agg(F.min("d").alias("least")), "least")
    small = materialize(small.join(least, "sha").withColumn("copy", (F.col("d") > F.col("least")) & (F.col("n_words") >= WINDOW)).drop("least"), "copies")

    # the smallest of each group of equal texts, once for each id and text
    searched = small.filter(~F.col("copy") & (F.col("n_words") >= WINDOW)).select("d", "key").distinct()
    runs = seen.filter(F.col("n_words") >= WINDOW).select("d", "key", F.explode(F.arrays_zip("low", "at", "n")).alias("r")).select("d", "key", "r.*")
    known = runs.select("low", "d").groupBy("low").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.count(F.lit(1)).alias("c"))
    known = materialize(known.filter(F.col("a") < F.col("z")).select("low", (F.col("c") > HOT).alias("hot")), "known")
    runs = runs.join(known, "low").groupBy("d", "key").agg(F.collect_set(F.struct("at", "n", "low", "hot")).alias("runs"))
    runs = materialize(runs.join(searched, ["d", "key"]), "runs")
    release(seen, least, known)
    windows = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + F.when(r["hot"], r["n"]).otherwise(0))
    total, hot_windows = runs.agg(F.sum(F.size("runs")), F.sum(windows)).first()
    buckets = max(MIN_BUCKETS, -(-(total or 0) // RUNS_A_BUCKET))
    hot_buckets = max(MIN_BUCKETS, -(-(hot_windows or 0) // WINDOWS_A_BUCKET))

    found = rows.filter(F.octet_length("text") >= 2 * WINDOW - 1).select("d", "key", "text").join(runs, ["d", "key"])
    found = materialize(found.select("d", "key", "text", "runs"), "searched")
    release(runs)
    travels = found.mapInArrow(_packed(buckets, hot_buckets), "bucket long, kind int, d long, key long, at int, n int, data binary")
    spans = travels.groupBy("bucket").applyInArrow(_count, "d long, key long, spans binary")
    spans = materialize(spans.groupBy("d", "key").agg(F.collect_list("spans").alias("spans")), "spans")  # one for each bucket that a text meets
    cut = found.select("d", "key", "text").dropDuplicates(["d", "key"]).join(spans, ["d", "key"]).select("d", "key", "text", "spans")
    cut = cut.mapInArrow(_removed, "d long, key long, removed long, kept_text string, kept_sha string")
    if not with_text:
        cut = materialize(cut.drop("kept_text"), "cut")
        release(found, spans)
    out = small.join(cut, ["d", "key"], "left")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0)))
    sha = F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha"))))
    text = [F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []
    return out.select("doc_id", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"), *text)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
#: All windows at once: fit for small tables.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(list_slice(w, i, i + 49), ' '))) AS k FROM d WHERE len(w) >= 50)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM k JOIN (SELECT k, min(doc_id) AS least FROM k GROUP BY k) USING (k), range(50) r(j) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(g.p) AS gone, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (g.p IS NULL), '') AS t FROM words LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
ORACLES = {"op9_substring_dedup": ORACLE}
