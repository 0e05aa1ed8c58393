"""The pipeline's stages, each against a plain version on its own input."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from leadweave.llm.common import leftovers, materialize, release, scratch_root
from leadweave.llm.quality import THRESHOLD, fit, score
from leadweave.llm.stages import COLUMNS, documents, repeat_to_weights

SF = "/root/testdata/sf0.001"


def near_components(docs):
    """Smallest id of each document's component, from all pairs."""
    sets = []
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


@pytest.fixture(scope="module")
def kept(spark):
    out = [documents(spark.read.parquet(f"{SF}/documents.parquet")).persist()]
    for _, f in cp.STAGES:
        out.append(f(spark, out[-1], SF).persist())
    return out


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_columns(kept):
    assert all(tuple(d.columns) == COLUMNS for d in kept[:-1])
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


def test_quality(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in score(kept[0], fit(kept[0], labels)).collect() if r.score >= THRESHOLD}
    assert rows(kept[1]) == [r for r in rows(kept[0]) if r[0] in good]
    assert 0 < len(good) < kept[0].count()


def test_exact(kept):
    first = {}
    for r in rows(kept[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    assert rows(kept[2]) == sorted(first.values())


def test_near(kept):
    before = rows(kept[2])
    parent = near_components([(r[0], r[1]) for r in before])
    assert rows(kept[3]) == [r for r in before if parent[r[0]] == r[0]]


def test_mixing(kept):
    before, after = rows(kept[3]), rows(kept[4])
    assert set(after) <= set(before)
    assert max(after.count(r) for r in set(after)) <= 2
    words = lambda rs: sum(len(r[1].split()) for r in rs)
    assert abs(words(after) / words(before) - 1.5) < 0.1


def test_packing(kept):
    from tokenizers import Tokenizer

    whole, want = Tokenizer.from_file(cp.TOKENIZER), {}
    for r in rows(kept[4]):
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            key = (r[0], s, zlib.crc32(np.asarray(ids[s : s + 2048], "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in kept[5].collect():
        assert zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
        got[r.doc_id, r.start, r.ids_crc32] = got.get((r.doc_id, r.start, r.ids_crc32), 0) + 1
    assert got == want


def test_edges(spark):
    text = "one two three four five six seven"
    r = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text + " ", "en", "a"), (None, "other text here", None, None), (None, "other text here", None, None), (3, None, "en", "b"), (4, "", "en", "b"), (5, "x " * 5000, "en", "b")]
    d = spark.createDataFrame([(*x, 3, "clash", 9) for x in r], "doc_id long, text string, lang string, source string, n_chars long, TEXT string, size int")
    for _, f in cp.STAGES:
        d = f(spark, d, SF)
        assert d.count() > 0
    e = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in cp.STAGES:
        e = f(spark, e, SF)
        assert e.count() == 0
    twice = spark.createDataFrame([(1, "a b", "en", "s", 3)] * 4, "doc_id long, text string, lang string, source string, n_chars long")
    assert repeat_to_weights(twice).count() == 6


def test_run_leaves_one_table(spark):
    """A stage's own tables, and what it read, go when it is written."""
    before = leftovers()
    out = cp.run(spark, SF)
    left = leftovers() - before
    assert len(left) == 1 and "lw-mixing" in next(iter(left))
    assert out.count() > 0


def test_scratch_is_shared_or_refused(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session())
    t = materialize(spark.range(3), "t")
    assert t.count() == 3 and len(leftovers()) >= 1
    n = len(leftovers())
    release(t, t, spark.range(1))
    assert len(leftovers()) == n - 1
