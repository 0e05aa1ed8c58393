"""Many terms in one pass, and words inside terms by their rarest pieces, against plain searches."""

import random
import re

from pyspark.sql import functions as F

from leadweave.functions import classify as C
from leadweave.functions import terms as T
from leadweave.functions import values as V
from leadweave.operators import lookup


def test_scores_equal_expressions(spark):
    r = random.Random(3)
    pool = ["firm", "services firm", "services", "agency", "ai", "Saas", "consulting", "firma", "_firm", "firm1", "éfirm", "firḿ", "áfirm", "non-profit", "a1", "½firm", "agency_firm", "shop", "store", "open source", "rpa", "x"]
    texts = [r.choice([" ", "", "-", "\n"]).join(r.choice(pool) for _ in range(r.randint(0, 25))) for _ in range(400)] + ["", None, "firm" * 3, "firm firm", "services firm firm"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    t = F.lower(F.coalesce("t", F.lit("")))
    held, counted = T.table(V.INDUSTRIES) + T.table(V.COMPANY_TYPES), T.table({**V.ORGANISATION_WORDS, "firms": ("firm", "services firm", "services", "firm services")})
    want = [sum(F.when(F.contains(t, F.lit(w)), 1).otherwise(0) for w in words) for _, words in held]
    want += [F.regexp_count(t, F.lit(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b")) for _, words in counted]
    rows = d.select("t", T.scores(held, counted)(t).alias("got"), F.array(*[w.cast("long") for w in want]).alias("want")).collect()
    assert not [x for x in rows if x.got != x.want]


def test_empty_tables_and_words(spark):
    d = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    assert [x[0] for x in d.select(T.scores(())(F.col("t"))).collect()] == [[], [], []]
    assert [x[0] for x in d.select(T.scores((("a", ("", "b", "b")),), (("c", ()),))(F.col("t"))).collect()] == [[2, 0], [1, 0], [1, 0]]
    assert d.limit(0).select(T.scores((("a", ("b",)),))(F.col("t"))).count() == 0


def test_classes_of_one_plan_share_a_pass(spark):
    d = spark.createDataFrame([("We sell cloud security; saas", "https://a.com"), (None, "https://b.org/"), ("a foundation", "https://b.org/")], "t string, u string")
    out = d.select(C.industry(F.col("t")).alias("i"), C.company_type(F.col("t")).alias("c"), C.organisation(F.col("t"), F.col("u")).alias("o"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("pythonUDF0#") and "pythonUDF1#" not in plan
    assert [tuple(x) for x in out.collect()] == [("Cloud Computing", "Software Company", "B2B Software"), ("Unknown", "Unknown", "NGO"), ("Unknown", "Unknown", "Open Source")]


def _closest(keyword, ontology):
    q = keyword[0].strip().lower() if keyword[0] is not None else ""
    if not q:
        return None
    entries = [(o[0], (o[1] or "").lower(), float(o[2]), 1) for o in ontology if o[1] is not None]
    for d in {o[0] for o in ontology}:
        entries.append((d, d.lower(), min(o[2] for o in ontology if o[0] == d) - 0.5, 0))
    met = []
    for d, term, ordinal, exact in entries:
        if term in (q, keyword[1]):
            met.append((exact, 0, ordinal, d))
        elif q in term:
            met.append((2, len(term), ordinal, d))
    return min(met)[3] if met else None


def test_closest_domain_equals_plain_search(spark):
    from leadweave.functions import names as N

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abé 😀") for _ in range(n))
    ontology = [(f"d{r.randint(0, 9)}", word(r.randint(0, 12)), i // 2) for i in range(120)] + [("big data", "data lake", 500), ("x", None, 501), ("big data", "Data Lake", 502)]
    keywords = [word(r.randint(0, 6)) for _ in range(200)] + ["Data", " lake ", "big data", "DATA LAKE", "a", "", None, "ata l", "nothing here", "data", "data"]
    k = spark.createDataFrame([(x, i) for i, x in enumerate(keywords)], "keyword string, n int").repartition(3)
    o = spark.createDataFrame(ontology, "domain string, term string, ordinal int").repartition(2)
    label = {x.n: (x.l or "").lower() for x in k.select("n", N.concept(F.lower(F.trim("keyword"))).alias("l")).collect()}
    out = lookup.closest_domain(k, o)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert {x.n: x.domain for x in out.collect()} == {i: _closest((x, label[i]), ontology) for i, x in enumerate(keywords)}
    assert out.columns == ["keyword", "n", "domain"]
    assert lookup.closest_domain(k, o.limit(0)).filter("domain IS NOT NULL").count() == 0 and lookup.closest_domain(k.limit(0), o).count() == 0
