"""Base spans against Python's re, the method's spans by example."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from leadweave.llm import pii
from leadweave.llm.pii import KINDS, em, find_pii, op4_pii, span_classifier

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    return {"email": True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def base_spans(text):
    out = [(m.start(), k, m.end()) for k, p in enumerate(PLAIN[x] for x in KINDS) for m in re.finditer(p, text) if good(KINDS[k], m[0])]
    return sorted(out)


TEXTS = [
    None, "", "x@foo.bar_baz@q.r a@b@c.d a@b. @x.y é😀me.1@mail.example.com", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 99999999999999999999.1.1.1", "4111 1111-1111 1111 4111111111111112 5555555555554444.",
    "+1 (017) 555-7713 x +12 +1-2.3(4) 567 890 12 34 5678 9", "+1 (243) 555-5526 4111111111111111", "٤@٤.c ４１", "a" * 3000, "1" * 3000, "1-" * 2000 + "@" + "a." * 900, "+1" + "(" * 3000, "a@b" + ".c" * 40000,
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    return TEXTS + ["".join(r.choice(["@", ".", "+", "-", " ", "(", ")", "_", "é", "\n", "12", "a", "4111111111111111", "1.2.3.4", "+1 (017) 555-7713", "b@c.de"]) for _ in range(r.randint(1, 30))) for _ in range(400)]


def test_base_spans(spark, texts):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, s int, TEXT string").repartition(4)
    got = {r.doc_id: [(x.s, x.kind, x.e) for x in r.spans if x.base] for r in find_pii(d).collect()}
    assert got.keys() == set(range(len(texts)))
    for i, t in enumerate(texts):
        assert got[i] == base_spans(t or ""), t
    assert find_pii(d.limit(0)).count() == 0


def test_very_long_runs_end(spark):
    t = ["a" * 200000, "1" * 200000, "1-" * 60000 + "@" + "a." * 50000, "+1" + "(" * 100000, "a@b" + ".c" * 90000]
    got = {r.doc_id: [(x.s, x.kind, x.e) for x in r.spans] for r in find_pii(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(5)] == [[], [], [(0, 0, len(t[2]) - 1)], [], [(0, 0, len(t[4]))]]


def test_overlaps_and_sums(spark):
    r = random.Random(2)
    for n in (0, 1, 31, 32, 33, 1030):
        values = [r.randrange(9) for _ in range(n)]
        got = spark.createDataFrame([(values,)], "v array<bigint>").select(pii.sums_before(F.col("v"))).first()[0]
        assert got == [sum(values[:i]) for i in range(n)]
    spans = [(10 * i + r.randrange(3), 10 * i + 4 + r.randrange(3)) for i in range(40)]
    ends = [(s, s + r.randrange(1, 9)) for s in range(-5, 420, 3)]
    d = spark.createDataFrame([(spans, s, e) for s, e in ends] + [([], 1, 2)], "spans array<struct<s:int,e:int>>, s int, e int")
    got = [tuple(x) for x in d.select("s", "e", pii.overlaps(F.col("spans"), F.col("s"), F.col("e"))).collect()]
    assert got == [(s, e, any(a < e and s < b for a, b in spans)) for s, e in ends] + [(1, 2, False)]


def test_added_spans_by_brute_force(spark, texts):
    """What joins the base spans: by the trained weights, votes and overlaps, in plain Python."""
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in find_pii(d).collect():
        base = [x for x in r.spans if x.base]
        for x in r.spans:
            assert x.base or not any(b.s < x.e and x.s < b.e for b in base)
            assert x.base or re.search(pii.LOOSE.get(pii.ALL_KINDS[x.kind], pii.BASE["card"]), texts[r.doc_id][x.s : x.e])


def test_many_matches_in_one_text(spark):
    """Four times the matches take about four times as long, not sixteen."""
    took = []
    for n in (10_000, 40_000):
        d = spark.createDataFrame([(1, "tel (212) 555-0199 ip 1.2.3.4 " * (n // 2))], "doc_id long, text string")
        start = time.perf_counter()
        spans = find_pii(d).select(F.size("spans").alias("n")).first().n
        took.append(time.perf_counter() - start)
        assert spans == n
    assert took[1] < 6 * took[0]


def test_method_adds_spans_that_two_labelers_tell(spark):
    t = ["Call phone (212) 555-0199 now", "the code (212) 555-0199 here", "credit card 4111 1111 1111 1112 ok", "n 4111111111111112 n", "email me: joe [at] example [dot] com!", "server ip 10[.]0[.]0[.]7"] + [f"e-mail a{i}@b.com, tel +1 (212) 555-01{i:02d}" for i in range(40)]
    d = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r.doc_id: [t[r.doc_id][x.s : x.e] for x in r.spans] for r in find_pii(d).collect()}
    assert [got[i] for i in range(6)] == [["(212) 555-0199"], [], ["4111 1111 1111 1112"], [], ["joe [at] example [dot] com"], ["10[.]0[.]0[.]7"]]


def test_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    t = [f'token = "{key}"', f"sha {key} of a file", "an extraordinarilylongwordwithoutdigits", "https://example.com/a-very-long-path-of-words", "password: Abcdefgh1234567890XyZ", "x" * 50_000] + [f'api_key="{i:040x}" a{i}@b.com' for i in range(1 << 80, (1 << 80) + 30)]
    got = {r.doc_id: [t[r.doc_id][x.s : x.e] for x in r.spans if x.kind == 4] for r in find_pii(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()}
    assert got[0] == [key] and got[2] == got[3] == got[5] == [] and got[4] == ["Abcdefgh1234567890XyZ"]
    assert all(len(got[i]) == 1 for i in range(6, 36))
    q = {r.doc_id: r for r in op4_pii(spark, "/root/testdata/sf0.01").collect()}
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text rlike 'token = \"[0-9a-f]{40}'").select("doc_id").collect()
    assert some and all(q[r.doc_id].secrets and q[r.doc_id].n_spans > 0 for r in some)


def test_em_finds_the_reliable_labeler():
    cells = [((1, 1, 1), 300), ((1, 1, 0), 100), ((0, 0, 0), 300), ((0, 0, 1), 100), ((1, 0, 1), 10), ((0, 1, 0), 10)]
    p = em(cells)
    assert p[0] > 0.95 and p[1] > 0.9 and p[2] < 0.05 and p[3] < 0.1
    assert len(span_classifier([])) == 5 + len(pii.ALL_KINDS)


def test_query_columns(spark):
    r = op4_pii(spark, "/root/testdata/sf0.001")
    assert r.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "secrets"]
    docs = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for x in r.collect():
        want = base_spans(docs[x.doc_id] or "")
        text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
    assert pii.THRESHOLD == 0.5
