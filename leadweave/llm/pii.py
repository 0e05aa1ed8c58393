"""Personal data by weak supervision, in SQL functions only.

Candidate spans of four kinds come from patterns: the base ones and looser forms (written
out e-mail, defanged addresses, phone numbers without a country code, card numbers whose
check digit is off). Long runs of code characters are candidates of a fifth kind, secrets,
which has no base form. Three labelers vote on each: the strict regex, a gazetteer (top-level
domains, address ranges, issuers, area codes, forms of keys) and the words right before the
span. Votes are counted by pattern (at most 80 cells, whatever the corpus), expectation-maximisation
over those cells estimates how reliable each labeler is for each kind, and a logistic
span classifier is trained on the cells with its posteriors. Its score is applied to each
candidate as an expression. Base spans always stay; a looser candidate joins them if
its score reaches the threshold, two labelers agree and it overlaps no base span.

Patterns are possessive and start at the edge of a run only, so that no text, however
long, takes more than linear time; the matches are those of the plain patterns. Where they
are comes from sums in blocks, whether one overlaps a base span from a binary search, so that
many matches in one text take little more than linear time too.

Null or empty text: no spans. Very long texts: whole. Null doc_id, repeated rows and further
columns, also of clashing names: each row is judged by its text alone. Ties of start go by
kind. Empty table: empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm.common import materialize, pick

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
THRESHOLD, MIN_VOTES, BEFORE = 0.5, 2, 32

_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this have no valid match of the kind.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\[\.\][0-9]++){3}",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
LOOSE_NEEDS = {"email": r"[\[(]at[\])]", "ip": r"\[\.\]", "phone": r"[0-9]{3}[.-][0-9]{4}", "secret": LOOSE["secret"]}
#: Looser forms that count as strict.
STRICT = {"secret": r"^[0-9a-f]{32,}$|^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+_]+$"}

#: Gazetteers and context words.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|co|us|ca|in|biz|dev|app"
GAZETTEER = {
    "email": rf"(?i)(?:\.|dot[\])]\x20?)(?:{DOMAINS})$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-2][0-9])\b",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+[1-9]|\(?[2-9][0-9]{2})",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:AKIA|ASIA|AIza|gh[pousr]_|sk[-_]|xox[abp]-|eyJ).*)$",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write\x20to|courriel|correo)[^\n]*$",
    "ip": r"(?i)(?:\bip\b|host|server|address|login|client)[^\n]*$",
    "card": r"(?i)(?:card|visa|credit|payment|karte|carte|tarjeta)[^\n]*$",
    "phone": r"(?i)(?:phone|\btel\b|call|mobile|fax|whatsapp|telefon)[^\n]*$",
    "secret": r"(?i)(?:token|secret|api[_-]?key|access[_-]?key|passw(?:or)?d|pwd|bearer|credential)[^\n]*$",
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


CHUNK = 32


def sums_before(values: Column, levels: int = 2) -> Column:
    """For each element of an array of numbers the sum of those before it.

    Block by block: a block's start comes from the blocks' sums in the same way, an element's
    from its block's start and the elements between. Only the last level, which has one element
    for each CHUNK ** levels, appends to an array one by one.
    """
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")

    def of(v: Column) -> Column:
        if not levels:
            step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
            return F.aggregate(v, F.struct(zero.alias("at"), none.alias("out")), step, lambda a: a["out"])
        n = F.size(v)
        total = lambda lo, hi: F.aggregate(F.sequence(lo, hi), zero, lambda a, j: a + F.get(v, j))
        blocks = F.sequence(F.lit(0), ((n - 1) / CHUNK).cast("int"))
        block_sums = F.transform(blocks, lambda k: total(k * CHUNK, F.least(n, (k + 1) * CHUNK) - 1))

        def placed(starts: Column) -> Column:
            own = lambda i: F.when(i % CHUNK == 0, zero).otherwise(total(i - i % CHUNK, i - 1))
            return F.transform(v, lambda _, i: F.get(starts, (i / CHUNK).cast("int")) + own(i))

        return F.when(n == 0, none).otherwise(_let(sums_before(block_sums, levels - 1), placed))

    return _let(values, of)


def occurrences(text: Column, pattern: str) -> Column:
    """Matches in order: s (code points before it), m (the match), before (text before it).

    The gaps between matches are what split() leaves, so starts are sums of lengths.
    """

    def placed(v: Column) -> Column:
        lengths = F.transform(v["hits"], lambda m, i: (F.length(m) + F.length(F.get(v["gaps"], i))).cast("bigint"))

        def found(at: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                gap = F.get(v["gaps"], i)
                return F.struct((F.get(at, i) + F.length(gap)).cast("int").alias("s"), m.alias("m"), F.right(gap, F.lit(BEFORE)).alias("before"))

            return F.transform(v["hits"], one)

        return _let(sums_before(lengths), found)

    return _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), placed)


def overlaps(spans: Column, s: Column, e: Column) -> Column:
    """Whether one of these disjoint spans in order (s, e) meets [s, e): that is, the last one
    that starts before e, found by binary search, ends after s."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int") + 1)

    def step(a: Column, _: Column) -> Column:
        mid = ((a["lo"] + a["hi"]) / 2).cast("int")
        below = (a["lo"] < a["hi"]) & (F.get(spans, mid)["s"] < e)
        return F.struct(F.when(below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(below | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    last = F.aggregate(steps, start, step, lambda a: a["lo"] - 1)
    return (F.size(spans) > 0) & F.coalesce(_let(last, lambda i: F.when(i >= 0, F.get(spans, i)["e"] > s)), F.lit(False))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return a + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(plain) <= 3) & (F.substring(plain, 1, 3).cast("int") <= 255)


def valid(kind: str, m: Column) -> Column:
    """Whether a base match counts."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _small)
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _candidates(text: Column, kind: str, loose: bool) -> Column:
    pattern, needs = (LOOSE[kind], LOOSE_NEEDS[kind]) if loose else (BASE[kind], NEEDS[kind])

    def candidate(x: Column) -> Column:
        m = x["m"]
        base = F.lit(False) if loose else F.coalesce(valid(kind, m), F.lit(False))
        strict = m.rlike(STRICT[kind]) if kind in STRICT else base
        return F.struct(
            x["s"].alias("s"), F.lit(ALL_KINDS.index(kind)).alias("kind"), (x["s"] + F.length(m)).alias("e"), base.alias("base"), strict.alias("strict"),
            m.rlike(GAZETTEER[kind]).alias("listed"), x["before"].rlike(CONTEXT[kind]).alias("told"), m.rlike(r"[\x20()-]").alias("spaced"),
        )

    out = F.transform(occurrences(text, pattern), candidate)
    if not loose:
        # a failing match is no candidate, but for card numbers of the right length
        other = (lambda c: c["base"] | (c["e"] - c["s"]).between(14, 37)) if kind == "card" else (lambda c: c["base"])
        out = F.filter(out, other)
    return F.when(text.rlike(needs), out).otherwise(F.array().cast("array<struct<s:int,kind:int,e:int,base:boolean,strict:boolean,listed:boolean,told:boolean,spaced:boolean>>"))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def em(cells: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> list[float]:
    """Posterior of each cell (votes, count) that it is personal data; labelers err independently."""
    n = len(cells[0][0])
    prior, hit, false = 0.5, [0.8] * n, [0.2] * n
    post = [0.5] * len(cells)
    for _ in range(rounds):
        for i, (votes, _) in enumerate(cells):
            z = math.log(prior / (1 - prior)) + sum(math.log(h / f) if v else math.log((1 - h) / (1 - f)) for v, h, f in zip(votes, hit, false))
            post[i] = _sigmoid(z)
        yes, no = (sum(c * w for (_, c), w in zip(cells, ps)) for ps in (post, [1 - p for p in post]))
        prior = (yes + 1) / (yes + no + 2)
        for k in range(n):  # two spans of prior belief keep a labeler better than chance at the start
            hit[k] = (sum(c * p for (v, c), p in zip(cells, post) if v[k]) + 1.6) / (yes + 2)
            false[k] = (sum(c * (1 - p) for (v, c), p in zip(cells, post) if v[k]) + 0.4) / (no + 2)
    return post


def span_classifier(cells: list[tuple[int, tuple[int, ...], int, int]], steps: int = 300) -> list[float]:
    """Logistic weights over constant, three votes, spacing and kinds, from cells of
    (kind, votes, spaced, count); the targets are the posteriors of the kind's cells."""
    width = 5 + len(ALL_KINDS)
    w = [0.0, 1.0, 0.5, 0.5, 0.0] + [0.0] * len(ALL_KINDS)
    rows = []
    for kind in range(len(ALL_KINDS)):
        own = [c for c in cells if c[0] == kind]
        if own:
            rows += [([1.0, *map(float, v), float(s)] + [float(k == kind) for k in range(len(ALL_KINDS))], p, n) for (_, v, s, n), p in zip(own, em([(c[1], c[3]) for c in own]))]
    total = sum(math.log1p(n) for *_, n in rows)
    for _ in range(steps if rows else 0):
        g = [-0.01 * x for x in w]
        for x, p, n in rows:
            miss = (p - _sigmoid(sum(a * b for a, b in zip(w, x)))) * math.log1p(n) / total
            for i in range(width):
                g[i] += miss * x[i]
        w = [a + 0.5 * b for a, b in zip(w, g)]
    return w


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans: array<struct<s, kind, e, base>> in order, of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*[_candidates(text, k, loose) for loose in (False, True) for k in (LOOSE if loose else KINDS)])
    found = materialize(pick(docs, "doc_id", "text").select("doc_id", every.alias("c")), "pii")
    cells = found.select(F.explode("c").alias("c")).select("c.*").groupBy("kind", "strict", "listed", "told", "spaced").count().collect()
    w = span_classifier(sorted((r.kind, (int(r.strict), int(r.listed), int(r.told)), int(r.spaced), r["count"]) for r in cells))

    base_of = [F.filter("c", lambda c, k=k: c["base"] & (c["kind"] == k)) for k in range(len(KINDS))]
    found = found.select("doc_id", "c", *[b.alias(f"base{k}") for k, b in enumerate(base_of)])

    def joins(c: Column) -> Column:
        votes = [c[k].cast("int") for k in ("strict", "listed", "told")]
        z = F.lit(w[0]) + sum(v * F.lit(a) for v, a in zip(votes, w[1:4])) + c["spaced"].cast("int") * F.lit(w[4]) + F.element_at(F.array(*map(F.lit, w[5:])), c["kind"] + 1)
        meets = F.lit(False)
        for k in range(len(KINDS)):
            meets = meets | overlaps(F.col(f"base{k}"), c["s"], c["e"])
        return c["base"] | ((z >= math.log(threshold / (1 - threshold))) & (votes[0] + votes[1] + votes[2] >= MIN_VOTES) & ~meets)

    span = lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"), c["base"].alias("base"))
    return found.select("doc_id", F.array_sort(F.transform(F.filter("c", joins), span)).alias("spans"))


def _written(spans: Column) -> Column:
    name = lambda c: F.element_at(F.array(*map(F.lit, ALL_KINDS)), c["kind"] + 1)
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", name(c), c["s"].cast("string"), c["e"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kinds by contract; then n_spans (all spans, added ones and secrets too) and the secrets."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    personal, secret = (lambda c: c["kind"] < len(KINDS)), (lambda c: c["kind"] == len(KINDS))
    found = found.select("doc_id", F.filter("spans", personal).alias("spans"), F.filter("spans", lambda c: c["base"]).alias("base"), F.filter("spans", secret).alias("secrets"))
    of = lambda k: F.filter("base", lambda c: c["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = (F.size("spans") + F.size("secrets")).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), every, _written(F.col("secrets")).alias("secrets"))


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
