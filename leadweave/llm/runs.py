"""Periodic run detection: stretches of words that repeat with a period, from a suffix automaton.

For each document an automaton of the words is built. Its states are visited from the longest
to the shortest and hand their ordered sets of end positions to the state of their suffix link,
the smaller set going into the larger. Two ends that become neighbours there, at a distance d
not exceeding the state's length, are a square of period d. A run has pairs of ends for each of
its words, and they meet at states of all lengths; the pair of its last word meets at one whose
length reaches back to the run's first word. So the square that neither the word before nor the
word after continues is the whole run; of the distances of one stretch the smallest is its period.

A run reported here has a length of at least LEAST words and TIMES periods, so states shorter
than LEAST - 1 can't seed one and take no part. Every word of such a run occurs TIMES times in
it, and all its stretches of LEAST - 1 words at least twice. Words and stretches that don't,
in what is left between others of that kind, are taken out first; the automaton then covers
only the pieces that remain, with no loss.

Documents are independent: nothing is shuffled, and a text is in memory alone, whole. Null or
empty text: no words, no runs. Very long texts: whole; memory grows with the words that are left after
the first step. Null doc_id: kept as such. Repeated rows: each gets the same result. Ties: of
runs with equal exponents the smallest start, then the smallest period is first. Further
columns, also of clashing names, are passed over. Empty table: empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm.common import WORD, batch_slices, pick

LEAST, TIMES = 6, 4
RUN = "start long, length long, period long"


def candidates(w: np.ndarray) -> list[tuple[int, int]]:
    """Pieces (from, to) outside which no run can lie: see above."""
    gram, pieces, done = LEAST - 1, [(0, len(w))], []
    while pieces:
        lo, hi = pieces.pop()
        x = w[lo:hi]
        _, x, times = np.unique(x, return_inverse=True, return_counts=True)
        keep = times[x] >= TIMES
        if keep.all() and len(x) >= LEAST:
            code = np.zeros(len(x) - gram + 1, dtype=np.uint64)
            for k in range(gram):  # equal stretches have equal codes
                code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[k : k + len(code)].astype(np.uint64)
            _, code, times = np.unique(code, return_inverse=True, return_counts=True)
            bad = np.flatnonzero(times[code] < 2)
            if len(bad):  # no run has one of these whole: a piece ends before its last word, the next begins after its first
                ends = zip([0, *(bad + 1).tolist()], [*(bad + gram - 1).tolist(), len(x)])
                pieces += [(lo + s, lo + e) for s, e in ends if e - s >= LEAST]
                continue
            done.append((lo, hi))
            continue
        edge = np.flatnonzero(np.diff(keep, prepend=False, append=False))
        pieces += [(lo + s, lo + e) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()) if e - s >= LEAST]
    return done


def automaton(w: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end (-1 for copies) of each state.

    Most states have one way on: it is in two lists, further ones in a dictionary of the state.
    """
    length, link, end = [0], [-1], [-1]
    word, to, more = [-1], [0], {}
    last = 0
    for i, c in enumerate(w):
        cur = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        word.append(-1)
        to.append(0)
        p, last = last, cur
        while p >= 0:
            if word[p] == c:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = c, cur
            else:
                ways = more.get(p)
                if ways is None:
                    more[p] = {c: cur}
                elif c in ways:
                    q = ways[c]
                    break
                else:
                    ways[c] = cur
            p = link[p]
        if p < 0:
            continue
        if length[q] == length[p] + 1:
            link[cur] = q
            continue
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        end.append(-1)
        word.append(word[q])
        to.append(to[q])
        if q in more:
            more[copy] = dict(more[q])
        link[q] = link[cur] = copy
        while p >= 0:
            if word[p] == c:
                if to[p] != q:
                    break
                to[p] = copy
            else:
                ways = more.get(p)
                if ways is None or ways.get(c) != q:
                    break
                ways[c] = copy
            p = link[p]
    return length, link, end


def piece_runs(w: list[int]) -> dict[tuple[int, int], int]:
    """(start, end) to period of the runs of one piece."""
    length, link, end = automaton(w)
    n, shortest = len(w), LEAST - 1
    sets: list[list[int] | None] = [None] * len(length)
    found: dict[tuple[int, int], int] = {}

    def seed(first: int, second: int, long: int) -> None:
        d = second - first
        if long + d < LEAST or long + d < TIMES * d or (second + 1 < n and w[second + 1] == w[first + 1]):
            return
        if first < long or w[first - long] != w[second - long]:  # else both came from one state, and were a pair there
            key = (second - long - d + 1, second + 1)
            if d < found.get(key, n):
                found[key] = d

    sizes = np.array(length)
    order = np.argsort(-sizes, kind="stable")[: int((sizes >= shortest).sum())].tolist()
    for s in order:  # all that hand their ends to a state are longer than it
        if end[s] >= 0:
            own = sets[s]
            # ends are held negated: in a periodic text the new one is smaller, and goes to the list's end
            if own is None:
                sets[s] = [-end[s]]
            else:
                _insert(own, -end[s], length[s], seed)
        mine, up = sets[s], link[s]
        sets[s] = None
        if length[up] < shortest:
            continue
        other = sets[up]
        if other is None:
            sets[up] = mine
            continue
        if len(other) < len(mine):
            mine, other = other, mine
        for x in mine:
            _insert(other, x, length[up], seed)
        sets[up] = other
    return found


def _insert(held: list[int], x: int, long: int, seed) -> None:
    at = bisect_left(held, x)
    if at < len(held):
        seed(-held[at], -x, long)
    if at:
        seed(-x, -held[at - 1], long)
    held.insert(at, x)


def word_runs(words: list) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of a list of words, by start, then period."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    w = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    found = {}
    for lo, hi in candidates(w):
        for (s, e), d in piece_runs(w[lo:hi].tolist()).items():
            found[lo + s, lo + e] = min(d, found.get((lo + s, lo + e), len(words)))
    return sorted((s, e - s, d) for (s, e), d in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared as fractions; the first of equal ones."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """What is left when each run keeps its first period only."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, d in runs:
        gone[s + d] += 1
        gone[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period), strongest, collapsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        as_struct = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))
        for b in batch_slices(batches, 1):
            count, every, best, text = [], [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                w = (t or b"").split()
                runs = word_runs(w)
                count.append(len(w))
                every.append([as_struct(r) for r in runs])
                best.append(as_struct(strongest(runs)))
                text.append(b" ".join(kept_words(w, runs)))
            cols = [b.column(0), pa.array(count, pa.int64()), pa.array(every, pa.list_(struct)), pa.array(best, struct), pa.array(text, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, runs array<struct<{RUN}>>, strongest struct<{RUN}>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by its id's checksum) repeats from some word on."""
    d = pick(docs, "doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    g, n = F.expr("h div 10"), lambda w: F.size(w).cast("long")

    def repeated(w: Column) -> Column:
        a = g % n(w)
        p = 1 + F.floor((n(w) - a) / (3 + g % 8)).cast("long")
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(F.size(w) > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n(w) - 1), lambda i: F.get(w, at(i).cast("int"))), " ")).otherwise("")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    changed = F.transform(F.array(words), repeated)[0]  # the words are found once
    return d.select("doc_id", F.when(F.col("h") % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = collapse_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.col("strongest")
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
#: In SQL runs are a recursion over all pairs of words of a text.
ORACLES: dict[str, str] = {}
