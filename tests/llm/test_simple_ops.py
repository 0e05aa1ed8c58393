"""URL filter, exact dedup, packing, top-k and sharding against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadweave.llm.exact_dedup import as_words, build_mph, exact_dedup, find_slots
from leadweave.llm.packing import WordTokenizer, best_fill, pack, patterns
from leadweave.llm.sharding import hilbert_index, shard
from leadweave.llm import topk
from leadweave.llm.topk import as_integers, bounds, cell_edges, top_k
from leadweave.llm.url_filter import ORACLES, TERMS, longest_rule, rules_by_host, url_filter

DOCS = "doc_id long, text string, lang string, source string, TEXT string, bucket long, n int"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def rows(n=60):
    r = random.Random(5)
    words = ["alpha", "Beta", "don't", "42", "é", "<|endoftext|>", "naïve", "ΑΣ", "x" * 70, "\u00a0y", "a\x1cb"]
    out = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40, 900]))), r.choice(["en", None]), r.choice(["s1", "s2", None])) for i in range(n)]
    out += [(100, None, None, None), (101, "", "en", "s1"), (None, "alpha", "en", "s1"), (102, "alpha  beta\n", "en", "s1"), (102, "alpha  beta\n", "en", "s1"), (103, "alpha beta ", "en", "s1"), (104, "word " * 9000, "en", "s1")]
    return [(*x, "clash", 7, 7) for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_url_filter(spark):
    urls = ["http://www.Example.NET/en/1?x", "http://a.net/de/", "https://x.example.com/de/1", "http://b.org/fr/", "http://casino-win.example.com/", "http://free.example.com/x", "http://free-ads.example.com/x", "no scheme casino", None, "", "http://winter.example.com/", "http://notexample.com/de/", "http://net", "x://y://net/z"]
    t = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'q' host", "'q' PATH")
    got = {r.page_id: r for r in url_filter(t).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "block"), (None, "allow"), (None, "block"),
        (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (got[0].host, got[0].path, got[7].host, got[8].path, got[12].path) == ("www.example.net", "/en/1", "", "", "")
    assert url_filter(t.limit(0)).count() == 0


def test_weights_decide(spark):
    urls = ["http://x.com/best-deal/", "http://x.com/jackpot/best/", "http://x.com/jackpot/", "http://x.com/free/bonus", "http://x.com/free/free", "http://x.com/éfree/bonusé", "http://x.com/free1/bonus", "http://x.com/best-deal-vip-sale", "http://x.com/FREE_Bonus", "http://x.com/" + "a/" * 50_000 + "porn"]
    t = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[1]])], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.soft_terms, r.soft_weight) for r in url_filter(t).collect()}
    assert [got[i] for i in range(9)] == [("allow", 2, 0.6), ("block", 2, 1.1), ("allow", 1, 0.8), ("block", 2, 1.0), ("allow", 1, 0.5), ("block", 2, 1.0), ("allow", 1, 0.5), ("block", 4, 1.2), ("block", 2, 1.0)]
    assert got[9][0] == "block" and got[10] == got[1]
    table = spark.createDataFrame([("deal", "strict", None), ("best", "soft", 0.9), ("best", "soft", 0.1), (None, "soft", 1.0)], "term string, kind string, weight double")
    assert [r.verdict for r in url_filter(t, terms=table).orderBy("page_id").limit(2).collect()] == ["block", "allow"]


def test_url_sql_agrees(spark):
    import duckdb

    r = random.Random(6)
    bits = [*[t for t, _, _ in TERMS][::3], "é", "É", "1", "-", "/", "//", ".", "://", "?", "#", "net", "example.net", "EN", "/en/", "İ", "org/fr/", " ", "\n"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(1, 14)))) for i in range(3000)] + [(3000, None), (3001, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = sorted(con.execute(ORACLES["op2_url_filter"]).fetchall())
    assert sorted(tuple(x) for x in url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()) == want


def test_many_rules():
    rules = [("block", f"h{i}.com/p{i % 7}/") for i in range(5000)] + [("allow", "com/"), ("allow", "h3.com/p3/x/")]
    by_host = rules_by_host(rules)
    assert longest_rule("a.h3.com", "/p3/x/1", by_host) == ("h3.com/p3/x/", "allow")
    assert longest_rule("a.h3.com", "/p3/y", by_host) == ("h3.com/p3/", "block")
    assert longest_rule("xh3.com", "/p3/y", by_host) == ("com/", "allow")
    assert longest_rule("", "", by_host) == (None, None) == longest_rule("h3.com", "", by_host)


def test_perfect_hash():
    keys = as_words(hashlib.sha256(str(i).encode()).digest() for i in range(5000))
    levels, slots = build_mph(keys)
    assert sorted(slots) == list(range(5000))
    assert (find_slots(levels, keys) == slots).all()


@pytest.mark.parametrize("cut", [None, 0, 10**6])
def test_exact_dedup(docs, cut):
    got = exact_dedup(docs, cut).collect()
    groups = {}
    for d, t, *_ in rows():
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest(), []).append(d)
    assert len(got) == len(rows())
    for r in got:
        ids = [d for d in groups[r.text_sha256] if d is not None]
        assert (r.keep_id, r.group_size) == (min(ids) if ids else None, len(groups[r.text_sha256]))
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup(empty).count() == 0


def test_words_tokenise_as_texts():
    whole, texts = Tokenizer.from_file(VOCABULARY), [t or "" for _, t, *_ in rows()]
    r = random.Random(1)
    texts += ["".join(r.choice("aA é'1\u0301ß\t\n\u2028_.<|>\x85\x1fİ²½ŒsSǅ中ªΣ'tve\u00ad\u00a0") for _ in range(60)) for _ in range(300)]
    got = [np.frombuffer(x, "<u4").tolist() for x in WordTokenizer(VOCABULARY)([t.encode() for t in texts])]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_best_fill_is_optimal():
    r = random.Random(3)
    for _ in range(200):
        left = {n: r.randint(1, 3) for n in r.sample(range(1, 30), 5)}
        space, sums = r.randint(0, 60), {0}
        for n, c in left.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        used = best_fill(sorted(left, reverse=True), left, space)
        assert all(k <= left[n] for n, k in used.items())
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= space)
    many = {n: 1000 + n for n in range(1, 2048, 3)}
    total = {}
    for used, times in patterns(dict(many), 2048):
        assert sum(n * k for n, k in used.items()) <= 2048
        for n, k in used.items():
            total[n] = total.get(n, 0) + k * times
    assert total == many


def test_packing_is_whole(docs, empty):
    got = pack(docs, VOCABULARY, groups=2).collect()
    whole = Tokenizer.from_file(VOCABULARY)
    want = sorted(tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, *_ in rows())
    back = {}
    for r in sorted(got, key=lambda r: r.start):
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        back.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    texts = []
    for (doc, n), parts in back.items():
        if doc == 102:
            texts += [tuple(p.ids) for p in parts]
        else:
            assert sum(p.length for p in parts) == n
            texts.append(tuple(i for p in parts for i in p.ids))
    assert sorted(texts) == want
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at <= 2048
    assert pack(empty, VOCABULARY).count() == 0


def test_packing_pads_little(spark):
    got = pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), VOCABULARY, with_ids=False).collect()
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sum(used.values()) > 0.99 * 2048 * len(used)


def test_equal_rows_and_long_texts_meet_many_groups(spark):
    d = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text")).union(spark.createDataFrame([(1, "long " * 200_000)], "doc_id long, text string"))
    by_group = {}
    for r in pack(d, VOCABULARY, with_ids=False, groups=16).collect():
        by_group.setdefault(r.sequence_id >> 32, []).append(r.length)
    assert len(by_group) == 16 and max(len(g) for g in by_group.values()) < 200
    assert sum(map(len, by_group.values())) == 600 + -(-200_001 // 2048)


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
        at = hilbert_index(points, bits)
        assert sorted(at) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_sharding(docs, empty):
    got = shard(docs).collect()
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    sizes = [len(counts.get(k, [])) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows())
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    assert shard(empty).count() == 0


def plain_shards(rows, shards=16, bits=10):
    """(doc_id, crc, shard, slot) by a plain sort of all rows; rows: doc_id, text, lang, source."""
    def sixteenths(n):
        e = n.bit_length() - 1
        return e * 16 + (n >> (e - 4) if e >= 4 else n << (4 - e)) - 16

    keys = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), lang, src) for d, t, lang, src in rows]
    dims = [[k[3] for k in keys], [k[4] for k in keys], [sixteenths(k[1]) for k in keys]]
    points = np.zeros((len(keys), 3), dtype=np.int64)
    for i, values in enumerate(dims):
        rank = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
        cell = {}
        for v in sorted(set(values), key=rank):
            before = sum(rank(x) < rank(v) for x in values)
            cell[v] = (2 * before + values.count(v)) * (1 << bits) // (2 * len(values))
        points[:, i] = [cell[v] for v in values]
    curve = hilbert_index(points, bits).tolist()
    order = sorted(range(len(keys)), key=lambda i: (curve[i], keys[i][2], keys[i][1], keys[i][0] is not None, keys[i][0] or 0))
    out, n = [], len(keys)
    for at, i in enumerate(order):
        k = at * shards // n
        out.append((keys[i][0] if keys[i][0] is not None else -1, keys[i][2], k, at - -(-k * n // shards)))
    return sorted(out), order


def test_sharding_by_brute_force(spark, docs):
    tie = [(900 + i, "tie", "en", "s1", "c", 1, 1) for i in range(9)] + [(1000, "tie", "de", "s2", "c", 1, 1), (1001, "x " * 90_000, "en", "source-with-a-long-common-prefix-1", "c", 1, 1), (1002, "y", "en", "source-with-a-long-common-prefix-2", "c", 1, 1)]
    data = rows() + tie
    got = shard(spark.createDataFrame(data, DOCS).repartition(4)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text_crc32, r.shard, r.slot) for r in got) == plain_shards([x[:4] for x in data])[0]
    supplied = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    data = [(r.doc_id, r.text, r.lang, r.source) for r in supplied.collect()]
    got = shard(supplied).collect()
    assert sorted((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got) == plain_shards(data)[0]
    # pruning: a filter on one dimension opens far fewer shards than rows dealt at random would
    at, meta = {r.doc_id: r.shard for r in got}, {d: (lang, src, len(t or "").bit_length()) for d, t, lang, src in data}
    for i, most in ((0, 9), (1, 9), (2, 13)):
        files = {}
        for d, m in meta.items():
            files.setdefault(m[i], set()).add(at[d])
        common = {v: f for v, f in files.items() if sum(m[i] == v for m in meta.values()) >= 40}
        assert sum(map(len, common.values())) / len(common) < most, (i, {v: len(f) for v, f in common.items()})


def test_cells_bound_products():
    r = np.random.default_rng(7)
    for big in (100, 10**9):
        v, q = r.integers(-big, big, (300, 7)), r.integers(-big, big, (20, 7))
        low, high = cell_edges(v.min(axis=0), v.max(axis=0))
        cells = ((v - v.min(axis=0)) // (low[:, 1] - low[:, 0])).astype(np.uint8)
        assert cells.max() > 128
        assert all((low[j, c[j]] <= x[j] <= high[j, c[j]]) for c, x in zip(cells, v) for j in range(7))
        bottom, top = bounds(q, cells, low, high)
        exact = [[int(sum(int(a) * int(b) for a, b in zip(x, y))) for y in v] for x in q]
        assert all(bottom[i, j] <= exact[i][j] <= top[i, j] for i in range(20) for j in range(300))


def plain_top_k(v):
    good = [(i, k, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e]) for k, (i, e) in enumerate(v) if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q, row, x in good:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, other, y in good if other != row and len(y) == len(x))
            want += [(q, k + 1, c, -y) for k, (y, c) in enumerate(s[:5])]
    return sorted(want)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELLS_A_BLOCK", 400)
    monkeypatch.setattr(topk, "COMPONENTS_A_QUERY_BLOCK", 20)
    r = np.random.default_rng(2)
    v = [(i, [float(x) for x in r.integers(-3, 4, 4) / 4]) for i in range(400)]
    v += [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (None, [1.0] * 4), (404, []), (450, [1.0, 2.0]), (451, [1.0, 1.0]), (950, [7.0] * 3)]
    v += [(i, [0.5] * 4) for i in range(500, 900)]
    v += [(500, [0.5] * 4), (0, [0.25] * 4), (0, [0.25] * 4), (550, [0.75] * 4)]
    t = spark.createDataFrame(v, "vec_id long, embedding array<float>").selectExpr("*", "'q' v", "1 score", "2 rid").repartition(3)
    ints = as_integers(t)
    got = sorted(tuple(x) for x in top_k(ints, ints.filter("vec_id % 50 = 0")).collect())
    assert got == plain_top_k(v)
    assert top_k(ints.limit(0), ints.limit(0)).count() == 0


def test_only_likely_vectors_are_read(spark):
    """3,000 queries: the cells leave few of the vectors to be read exactly."""
    r = np.random.default_rng(3)
    centre = r.normal(size=(40, 16))
    x = centre[r.integers(0, 40, 6000)] + r.normal(size=(6000, 16)) * 0.1
    t = spark.createDataFrame([(i * 25, [float(y) for y in e]) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    v = as_integers(t)
    got = {}
    for q in top_k(v, v.filter("vec_id % 50 = 0")).collect():
        got.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    assert len(got) == 3000 and all(len(g) == 5 for g in got.values())
    ints = np.floor(256 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    for i in range(0, 6000, 500):
        s = ints @ ints[i]
        s[i] = -(10**15)
        best = np.lexsort((np.arange(6000), -s))[:5]
        assert sorted(got[i * 25]) == [(k + 1, int(j) * 25, int(s[j])) for k, j in enumerate(best)]
    lo, hi = ints.min(axis=0), ints.max(axis=0)
    low, high = cell_edges(lo, hi)
    bottom, top = bounds(ints[::2], ((ints - lo) // (low[:, 1] - low[:, 0])).astype(np.uint8), low, high)
    least = -np.sort(-bottom, axis=1)[:, 5:6]
    assert (top >= least).sum() < 0.005 * top.size
