"""Periodic runs against a plain search of all periods, and the query against plain Python."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from leadweave.llm.runs import candidates, collapse_runs, kept_words, op12_periodic_runs, strongest, with_planted_runs, word_runs

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1) if j == i else j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_runs_equal_plain_search():
    r = random.Random(2)
    for k in range(4000):
        n, a = r.choice([0, 1, 5, 6, 7, 12, 30, 60, 150]), r.choice([1, 2, 3, 5, 30])
        w = [r.randrange(a) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if n > 8:
                s = r.randrange(n - 6)
                p, e = r.randint(1, max(1, (n - s) // 4)), r.randint(s, n)
                w[s:e] = [w[s + (i - s) % p] for i in range(s, e)]
        assert word_runs(w) == plain_runs(w), w


def test_long_texts():
    for n, p in ((100_000, 1), (100_000, 7), (100_000, 25_000), (99_999, 24_000)):
        assert word_runs([i % p for i in range(n)]) == [(0, n, p)]
    w = np.random.default_rng(0).integers(0, 10**6, 50_000)
    assert candidates(w) == [] and word_runs(w.tolist()) == []
    w[20_000:20_024] = np.tile(np.arange(6), 4)
    assert word_runs(w.tolist()) == [(20_000, 24, 6)] and len(candidates(w)) == 1


def test_strongest_and_kept():
    assert strongest([]) is None
    assert strongest([(0, 8, 2), (3, 12, 3), (9, 13, 3), (30, 26, 6)]) == (9, 13, 3)  # 26/6 equals 13/3: the first stays
    assert strongest([(0, 3 * 10**17 + 1, 3 * 10**16), (5, 10, 1)]) == (0, 3 * 10**17 + 1, 3 * 10**16)  # floats can't tell
    assert kept_words(list("abababab"), [(0, 8, 2)]) == ["a", "b"]
    w = list("xaaaaaaxaaaaaax" * 4)
    assert kept_words(w, word_runs(w)) == list("xaxax")  # runs within a run


SCHEMA = "doc_id long, text string, TEXT string, runs int"


def plain(doc_id, text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = strongest(runs)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def cases():
    r = random.Random(9)
    out = [(i, " ".join(r.choice(["a", "b", "é", "x y", "c d"]) for _ in range(r.choice([0, 1, 3, 9, 40, 200])))) for i in range(150)]
    out += [(500, None), (501, ""), (502, " \t\n"), (None, "a " * 9), (None, None), (503, "a\x1cb " * 7), (504, "ha " * 30_000), (505, "A a " * 5), (505, "A a " * 5)]
    return [(*x, "clash", 1) for x in out]


def test_documents(spark):
    t = spark.createDataFrame(cases(), SCHEMA).repartition(3)
    got = collapse_runs(t).collect()
    assert len(got) == len(cases())
    by = {(r.doc_id, r.n_words): r for r in got}
    assert [tuple(x) for x in by[504, 30_000].runs] == [(0, 30_000, 1)] and by[504, 30_000].collapsed == "ha"
    assert by[500, 0].runs == [] and by[500, 0].strongest is None and by[500, 0].collapsed == ""
    assert by[505, 10].collapsed == "A a" and tuple(by[505, 10].strongest) == (0, 10, 2)
    assert by[503, 7].collapsed == "a\x1cb" and by[None, 9].collapsed == "a"
    assert collapse_runs(t.limit(0)).count() == 0
    assert with_planted_runs(t).count() == len(cases())


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([c[:2] for c in cases() if c[0] != 504], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("which", ["made", "given"])
def test_query_equals_plain(spark, folder, which):
    path = folder if which == "made" else SF
    d = op12_periodic_runs(spark, path)
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{path}/documents.parquet{'/*.parquet' if which == 'made' else ''}')").fetchall()
    if which == "given":
        rows = [r for r in rows if len(r[1] or "") < 20_000]
    want = sorted((plain(*r) for r in rows), key=repr)
    ids = {r[0] for r in rows}
    assert sorted((tuple(r) for r in d.collect() if r.doc_id in ids), key=repr) == want
    assert any(r[1] for r in want)
    assert [k for k, t in d.dtypes] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for k, t in d.dtypes if not k.endswith("sha256")} == {"bigint"}
