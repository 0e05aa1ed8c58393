"""Whitening against exact rationals and numpy on small tables."""

import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from leadweave.llm import whitening
from leadweave.llm.whitening import as_integers, decompose, deviations, fit, limbs, products, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, EMBEDDING string"


def vectors(n=300, d=10, seed=3):
    r = random.Random(seed)
    return [(i, [r.gauss(0.3 * k, 1 + k / 5) for k in range(d)]) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rows = vectors()
    rows += [(900, None), (901, [1.0, None] + [0.0] * 8), (902, [float("nan")] + [0.0] * 9), (903, [float("inf")] + [0.0] * 9), (904, []), (905, [3e38] * 10)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (7, rows[8][1]), (906, [1.0, 2.0]), (907, [2.0, 1.0]), (908, [4.0, 4.5]), (909, [5.0])]
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA).repartition(5)


def exact(rows):
    """n, S, V as rationals of the integers."""
    n, d = len(rows), len(rows[0])
    s = [sum(x[k] for x in rows) for k in range(d)]
    v = [[sum((x[i] - Fraction(s[i], n)) * (x[j] - Fraction(s[j], n)) for x in rows) / n for j in range(d)] for i in range(d)]
    return n, s, v


def test_result(table):
    x = as_integers(table)
    got = whiten(x, fit(x)).collect()
    ints = [tuple(floor(1024 * float(np.float32(c))) + 100000 for c in v) for _, v in [*vectors(), vectors()[0], vectors()[7], vectors()[8]]]
    n, s, v = exact(ints)
    f = np.array([[float(c) for c in row] for row in v])
    values, vecs = np.linalg.eigh(f)
    values, vecs = values[::-1][:8], vecs[:, ::-1][:, :8]
    long = [r for r in got if r.n == n]
    assert len(long) == n * 8 and {r.component for r in long} == set(range(1, 9))
    by = {}
    for r in long:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert sum(1 for r in long if r.vec_id is None) == 8
    sign = None
    for vec_id, row in zip([i for i, _ in vectors()], ints):
        dev = sum((n * a - b) ** 2 for a, b in zip(row, s))
        r = by[vec_id, dev]
        assert all(int(r[k].deviation_exact) == dev for k in r)
        centred = np.array([float(a - Fraction(b, n)) for a, b in zip(row, s)])
        z = centred @ vecs / np.sqrt(values)
        mine = np.array([r[k].whitened for k in range(1, 9)])
        sign = np.sign(mine * z) if sign is None else sign
        assert np.abs(mine - z * sign).max() < 1e-9
        assert np.allclose([r[k].explained for k in range(1, 9)], values / np.trace(f), rtol=1e-9)
    z = np.array([[r[k].whitened for k in range(1, 9)] for r in by.values() if r[1].vec_id not in (None, 7)])
    assert len({r.identity_error for r in long}) == 1 and long[0].identity_error < 1e-9
    assert np.abs(z.T @ z / len(z) - np.eye(8)).max() < 0.05  # four of all rows are left out here


def test_identity_error_is_that_of_the_rows(spark):
    x = as_integers(spark.createDataFrame(vectors(200, 9, 4), "vec_id long, embedding array<float>"))
    got = whiten(x, fit(x)).collect()
    z = np.zeros((200, 8))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
    z = z - z.mean(axis=0)
    assert np.abs(z.T @ z / 200 - np.eye(8)).max() < 1e-9 and got[0].identity_error < 1e-9


def test_short_and_flat_vectors(table, spark):
    got = whiten(as_integers(table), fit(as_integers(table))).collect()
    two = {(r.vec_id, r.component): r for r in got if r.vec_id in (906, 907, 908)}
    assert set(two) == {(i, c) for i in (906, 907, 908) for c in (1, 2)} and {r.n for r in two.values()} == {3}
    one = [r for r in got if r.vec_id == 909]
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0)]
    flat = as_integers(spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(5)], "vec_id long, embedding array<double>"))
    rows = whiten(flat, fit(flat)).collect()
    assert {r.whitened is None for r in rows if r.component > 1} == {True} and all(r.whitened is not None for r in rows if r.component == 1)
    assert {r.component for r in rows} == {1, 2, 3} and rows[0].identity_error < 1e-12
    none = as_integers(table.limit(0))
    assert whiten(none, fit(none)).count() == 0


def test_huge_entries_stay_exact(spark):
    """Products far beyond 64 bits, with a variance that floats from the start would lose."""
    rows = [(i, [1e15 + 8 * (i % 7), float(i % 5), -2e15 + i]) for i in range(40)]
    x = as_integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    n, s, v = exact([tuple(floor(1024 * c) + 100000 for c in e) for _, e in rows])
    m = fit(x)[3]
    assert m.n == 40 and [w * n + r for w, r in zip(m.whole, m.rest)] == s
    assert np.allclose(m.values, np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in v]))[::-1], rtol=1e-9)
    got = {r.vec_id: r for r in whiten(x, {3: m}).collect()}
    for i, e in rows:
        dev = sum((n * (floor(1024 * c) + 100000) - b) ** 2 for c, b in zip(e, s))
        assert int(got[i].deviation_exact) == dev and got[i].deviation == (dev if dev < 2**63 else None)


def test_ways_agree():
    r = np.random.default_rng(1)
    for top in (100, 10**6, 2**40, 2**62):
        y = r.integers(-top, top, (50, 4))
        o = y.astype(object)
        assert (products(y).astype(object) == o.T @ o).all()
    for v in (0, 1, -1, 2**30, -(2**30) + 1, 3**100, -(7**60)):
        assert sum(k << (whitening.LIMB * i) for i, k in enumerate(limbs(v))) == v
    m = decompose(3, [3, 4], [[5, 4], [4, 10]])
    x = np.array([[100_001, 100_002], [2**40, -(2**40)]])
    want = [sum((3 * int(a) - (b + 3 * 100_000)) ** 2 for a, b in zip(row, (3, 4))) for row in x]
    assert [int(v) for v in deviations(x, m)] == want
