"""Quality classifier: messages against enumeration, and accuracy on the supplied labels."""

import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from leadweave.llm import quality
from leadweave.llm.quality import OWN_FEATURES, Field, fit, line_features, sample_of, score, text_scores, train, with_neighbours


def test_marginals_equal_enumeration():
    r = np.random.default_rng(4)
    each = np.array([1, 5, 3, 7, 2])
    x = r.normal(size=(each.sum(), 4))
    f = Field(r.normal(size=4), r.normal(size=(2, 2)))
    got, at = f.marginals(x, each), 0
    for n in each:
        e, total, good = x[at : at + n] @ f.weights, 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(e[i] for i in range(n) if y[i]) + sum(f.moves[a, b] for a, b in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_features_stay_within_a_text():
    texts = [b"", b"abc abc ab\n\nABC!!", "é é".encode(), b"\n\n", b"same line\nsame line"]
    x, weight, each = line_features(texts)
    assert each.tolist() == [1, 3, 1, 3, 2] and len(x) == 10 and x.shape[1] == OWN_FEATURES
    assert np.isfinite(x).all() and x[0, -2] == 1 and x[9, -1] == 1 and x[8, -1] == 0
    assert x[1, -6] > 0.3 and x[4, -6] > 0.3
    alone = [with_neighbours(*[line_features([t])[k] for k in (0, 2)]) for t in texts]
    assert np.allclose(np.vstack(alone), with_neighbours(x, each))


@pytest.mark.parametrize("piece", [7, 16, 61, 1 << 10])
def test_long_texts_in_pieces(monkeypatch, piece):
    r = random.Random(piece)
    texts = [b"x", b"\n".join(b"word%d  word word, A%d!" % (i, i) * (i % 9) for i in range(400)), b"y z", b"ab cd " * 1000, b"ab ab" * 500, b"a" * 5000, b"same line " * 30 + b"\n" + b"same line " * 30, b"\n" * 90, b"x" * 64 + b"\n", b" " * 200]
    texts += [bytes(r.choice(b"ab \n\t\xc3\xa9") for _ in range(r.randint(0, 300))) for _ in range(150)]
    texts += [b"".join(r.choice([b"aa", b"bb", b"q" * 90, b" ", b" ", b"\n"]) for _ in range(60)) for _ in range(50)]
    whole = line_features(texts)
    monkeypatch.setattr(quality, "PIECE", piece)
    for a, b in zip(whole, line_features(texts)):
        assert a.tobytes() == b.tobytes()


def test_memory_of_a_very_long_text():
    field = Field(np.ones(3 * OWN_FEATURES + 1), np.zeros((2, 2)), 1.0, 0.0)
    for text in (b"some words " * 2_000_000, b"x" * 20_000_000, b"a line of words\n" * 300_000):
        tracemalloc.start()
        s, each, _ = text_scores(field, [text])
        assert tracemalloc.get_traced_memory()[1] < 600 << 20 and 0 < s[0] < 1 and each[0] == text.count(b"\n") + 1
        tracemalloc.stop()


def test_sample_of_a_long_document():
    lines = [b"%d" % i for i in range(1000)]
    got = sample_of(b"\n".join(lines)).split(b"\n")
    assert len(got) == 128 and got == lines[int(got[0]) :][:128]
    assert sample_of(b"a" * 9000) == b"a" * 9000 and sample_of(b"") == b""


def test_trained_field_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids with a field that is trained."""
    good = [(i, "A plain sentence of some words.\nAnother one, as good as that.") for i in range(1, 200, 2)]
    bad = [(i, "$$$ ||| 000 ###\n" * 5) for i in range(2, 200, 2)]
    odd = [(500, None), (501, ""), (None, "A plain sentence."), (502, "A plain sentence of some words.\n" * 20_000), (502, "A plain sentence of some words.\n" * 20_000), (3, "$$$"), (3, "$$$")]
    docs = spark.createDataFrame([(*r, "e", 1) for r in good + bad + odd], "doc_id long, text string, TEXT string, quality int")
    labels = spark.createDataFrame([(d, d % 2, 0) for d, _ in good + bad], "doc_id long, quality int, toxic int")
    got = {}
    for r in score(docs, fit(docs, labels)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == 206
    assert got[1][0].score > 0.9 > 0.1 > got[2][0].score
    assert got[502][0].score == got[502][1].score and got[502][0].n_lines == 20_001
    assert got[500][0].score == got[501][0].score and len(got[3]) == 3
    alone = score(docs.filter("doc_id = 502").limit(1), fit(docs, labels)).first()
    assert alone.score == got[502][0].score


def test_one_label_only_gives_half():
    x, w, e = line_features([b"abc", b"d e f"])
    f = train(with_neighbours(x, e), w, e, np.array([1, 1]))
    assert (f.score(f.quality(with_neighbours(x, e), w, e)) == 0.5).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score(docs, fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x " * 60000), (3, "x " * 60000), (4, "\n" * 3000)]
    docs = spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, text string, TEXT string, quality int")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = score(docs, fit(docs, labels)).collect()
    assert len(got) == 6 and all(r.score == 0.5 for r in got)
    assert score(docs.limit(0), fit(docs.limit(0), labels.limit(0))).count() == 0
