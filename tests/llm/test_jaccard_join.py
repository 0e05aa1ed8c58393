"""Jaccard components against all pairs of sets."""

import random

import numpy as np
import pytest

from leadweave.llm import jaccard_join as jj
from leadweave.llm.common import leftovers


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def plain(rows):
    """Smallest id of each row's component, from all pairs with a common shingle."""
    sets, parent, by = [(d, shingles(t)) for d, t in rows], {d: d for d, _ in rows}, {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for i, (d, s) in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            e, t = sets[j]
            both = len(s & t)
            if d is not None and e is not None and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
                seen.add((i, j))
    return [(d, len(s), find(d) if d is not None else None) for d, s in sets]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, out = text(60), []
    for _ in range(60):
        base = text(r.choice([3, 5, 6, 8, 12, 20, 40, 90, 200, 600]))
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 2)
            out.append(w)
    out += [passage + text(r.randint(5, 25)) for _ in range(80)]
    out += [["Same"] * n for n in (1, 4, 5, 6, 300)] + [["same"] * 9]
    ids = r.sample(range(10**6), len(out))
    rows = [(i, " ".join(w).replace("w1 ", "W1\n")) for i, w in zip(ids, out)]
    return rows + [(2_000_000, None), (2_000_001, " \n"), (None, "same " * 9), (rows[0][0], rows[0][1]), (rows[1][0], "another text of this id"), (3_000_000, "another text of this id")]


def test_levels_and_groups():
    for c in range(25):
        a, b = jj.LEVELS[c], jj.LEVELS[c + 1] - 1
        assert jj.LEVELS[c + 2] > b * 100 // 80  # partners are in the next level at most
        most = max((x + y - 2 * -(-80 * (x + y) // 180)) for x in (a, b) for y in (a, b))
        assert jj.GROUPS[c] - jj.SLACK[c] - 1 >= most


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(3)
    for _ in range(600):
        n = int(r.choice([1, 2, 4, 5, 7, 11, 30, 100, 400]))
        a = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        drop = r.permutation(len(a))[: r.integers(0, max(1, len(a) // 5) + 1)]
        b = np.union1d(np.delete(a, drop), r.integers(0, 1 << 64, int(r.integers(0, max(1, n // 5) + 1)), dtype=np.uint64))
        if not jj.linked(a, b):
            continue
        value, cut = np.r_[a, b], np.array([0, len(a), len(a) + len(b)])
        doc, sig, _ = jj.signatures(value, cut, np.array([0, 1]))
        both = len(set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist()))
        assert both >= max(jj.shared_at_least(value, cut))


@pytest.mark.parametrize("top", [6, 300])
def test_rtree_loses_no_pair(top):
    r = np.random.default_rng(5)
    base = r.integers(0, top, (12, 40))
    points = np.clip(np.repeat(base, 20, axis=0) + r.integers(-1, 2, (240, 40)) * (r.random((240, 40)) < 0.2), 0, 255).astype(np.uint8)
    size, label, doc = points.sum(axis=1).astype(np.int64), r.integers(0, 50, 240), r.permutation(240)
    tree = jj.CountTree(points, size, node=8)
    p = np.where(points == 255, 65535, points.astype(int))
    want = {(i, j) for i in range(240) for j in range(i) if label[i] != label[j] and 180 * np.minimum(p[i], p[j]).sum() >= 80 * (size[i] + size[j]) and min(size[i], size[j]) * 100 >= 80 * max(size[i], size[j])}
    got = {(max(i, j), min(i, j)) for i, j, _ in jj.search(tree, doc, label, "all")}
    assert got == want and want
    for how in ("first", "nearest"):
        some = jj.search(tree, doc, label, how)
        assert {(max(i, j), min(i, j)) for i, j, _ in some} <= want and some
    best = {i: b for i, _, b in jj.search(tree, doc, label, "nearest")}
    bound = lambda i, j: int(np.minimum(p[i], p[j]).sum())
    assert all(best[i] == max(bound(i, j) for x in want for j in x if i in x and j != i) for i in best)
    leads = {i for i, _, _ in jj.search(tree, doc, label, "first")}
    led = {j for _, j, _ in jj.search(tree, doc, label, "first")}
    assert not leads & led  # a document that has a partner leads no others


@pytest.mark.parametrize("way", ["plain", "blocks", "hot"])
def test_equals_all_pairs(spark, rows, way, monkeypatch):
    if way == "blocks":  # every bundle is cut, and the last search does all the work
        monkeypatch.setattr(jj, "BLOCK", 4)
        monkeypatch.setattr(jj, "SEARCHES", ("all",))
    if way == "hot":
        monkeypatch.setattr(jj, "HOT_BATCH", 3)
        monkeypatch.setattr(jj, "BLOCK", 16)
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, TEXT string").repartition(2)
    got = [tuple(r) for r in jj.jaccard_components(d).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_a_hot_group_and_a_long_text(spark):
    """Half of all rows are near copies of one text; nothing grows with the square of their number."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base) if i % 2 else [f"u{r.randrange(9999)}" for _ in range(80)]
        w[r.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    long = [f"l{r.randrange(10**6)}" for _ in range(60_000)]
    rows += [(1000, " ".join(long)), (1001, " ".join(long[:59_000]))]
    before = leftovers()
    out = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(leftovers() - before) == 2  # what the result is read from
    got = {d: c for d, _, c in out.collect()}
    assert {got[i] for i in range(1, 400, 2)} == {1} and got[1001] == 1000
    assert all(got[i] == i for i in range(0, 400, 2))


def test_nothing(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(tuple(r) for r in jj.op10_jaccard_join(spark, "/root/testdata/sf0.01").collect()) == sorted(want)
