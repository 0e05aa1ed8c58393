"""Substring dedup against a plain search over all windows."""

import hashlib
import random

import numpy as np
import pytest

from leadweave.llm import substring_dedup as sd
from leadweave.llm.common import leftovers
from leadweave.llm.words import gram_hashes, rolling_hashes, sliding_min, words

W = 50


def plain(rows):
    first, split = {}, [(d if d is not None else sd.NO_ID, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - W + 1):
            k = tuple(w[i : i + W])
            first[k] = min(first.get(k, d), d)
    out = []
    for (doc, _), (d, w) in zip(rows, split):
        gone = set()
        for i in range(len(w) - W + 1):
            if first[tuple(w[i : i + W])] < d:
                gone.update(range(i, i + W))
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    vocabulary = [f"w{i}é" for i in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 80, 200)]
    out = []
    for i in range(250):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += r.choice(passages) if r.random() < 0.6 else text(r.randint(0, 60))
        out.append((r.randint(0, 10_000), r.choice([" ", "\n", " \t"]).join(parts)))
    out += [(20_000, None), (20_001, ""), (None, " ".join(passages[4])), (None, " ".join(passages[4])), (5, "same " * 300), (7, "same " * 130), (7, "same " * 130), (7, " ".join(passages[4]) + " x"), (9, " ".join(text(300)) + " " + " ".join(passages[4]) * 2), (30_000, "same " * 300)]
    return out


def test_words():
    raw = " a\tBc\n\né  x".encode()
    begin, end, h = words(raw)
    assert [raw[a:b] for a, b in zip(begin, end)] == raw.split()
    assert len(set(h.tolist())) == 4 and (words(b"a bc \xc3\xa9 x")[2] == words(raw, lower=True)[2]).all()
    assert all(len(words(x)[2]) == 0 for x in (b"", b" \n"))
    for n in (1, 2, 3, 41):
        g = np.random.default_rng(1).integers(0, 1 << 63, 60).astype(np.uint64)
        assert (sliding_min(g, n) == [g[i : i + n].min() for i in range(60 - n + 1)]).all()
    h = words(b"a b c a b c a b c")[2]
    for f in (gram_hashes, rolling_hashes):
        g = f(h, 4)
        assert len(g) == 6 and g[0] == g[3] and len(set(g.tolist())) == 3


@pytest.mark.parametrize("hot", [1000, 3])
def test_equals_plain_search(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "MIN_BUCKETS", 8)
    monkeypatch.setattr(sd, "KNOWN_WINDOWS", 40)
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, TEXT string").repartition(6)
    got = [tuple(r) for r in sd.substring_dedup(d).drop("kept_text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_nothing(spark):
    assert sd.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_hot_passage_and_a_long_text(spark):
    r = random.Random(9)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"u{r.randrange(10**6)}" for _ in range(r.randint(0, 60))] + passage + [f"v{i}"])) for i in range(700)]
    long = [f"l{r.randrange(10**7)}" for _ in range(100_000)]
    rows += [(1000, " ".join(long)), (1001, " ".join(["x", *long[500:99_000], "y"]))]
    before = leftovers()
    out = sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_text=False)
    assert len(leftovers() - before) == 2  # what the result is read from
    assert sorted(tuple(x) for x in out.collect()) == sorted(plain(rows))


def test_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(tuple(r) for r in sd.op9_substring_dedup(spark, "/root/testdata/sf0.001").collect()) == sorted(want)
