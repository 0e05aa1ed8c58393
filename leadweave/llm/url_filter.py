"""URL filter: host/path rules, then a weighted vocabulary matched by Aho-Corasick.

One automaton holds strict and soft terms. A term counts where both neighbours are no ASCII
letters or digits. One strict hit rejects. Soft terms have weights: at least two distinct
ones reject if their weights together reach the threshold, so two light ones alone do not,
nor does one however heavy. An explicit rule, where one fits, goes before that. Rules and
terms are looked up by host and by automaton, so thousands of them cost no more than a few.

Null url, or none with "://": host and path are empty and no rule fits; the vocabulary
still judges what text there is (null: allow). Very long urls: whole. Letters other than A-Z
are compared as they are. Ties: of rules of one length (they can't differ and both fit) the
last in order. Rows are judged one by one: repeated rows and further columns, also of clashing
names, make no difference, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm.common import pick

#: The rules of the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Vocabulary. Strict terms, and soft terms by weight; all lower case.
STRICT = (
    "adult", "bets", "casino", "casinos", "crack", "escort", "escorts", "hentai", "keygen", "malware", "nsfw", "nude",
    "phishing", "pills", "porn", "porno", "sex", "spam", "torrent", "viagra", "warez", "xxx",
)
SOFT = {
    0.8: ("betting", "clickbait", "jackpot", "lottery", "payday", "poker", "replica", "roulette", "sexy", "slots"),
    0.5: ("ads", "adserver", "affiliate", "bonus", "cheap", "coupon", "crypto", "diet", "discount", "download", "farm", "free", "loan", "loans", "popup", "seo", "track", "tracker", "win", "winner"),
    0.3: ("app", "best", "buy", "click", "deal", "deals", "offer", "offers", "online", "promo", "sale", "shop", "top", "vip"),
}
TERMS = tuple((t, "strict", 1.0) for t in STRICT) + tuple((t, "soft", w) for w, terms in SOFT.items() for t in terms)
MIN_SOFT, THRESHOLD, MAX_TERMS = 2, 1.0, 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
_INSIDE = frozenset(_LOWER + "0123456789")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, at, 1), _UPPER, _LOWER), F.regexp_extract(url, at, 2)


def vocabulary(terms: DataFrame | Iterable[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """(term, kind, weight) of a table or of rows; at most MAX_TERMS. Of a term that is listed
    several times the strict kind, then the largest weight counts. Null or empty terms are passed over."""
    if isinstance(terms, DataFrame):
        found = terms.select("term", "kind", F.col("weight").cast("double")).limit(MAX_TERMS + 1).collect()
    else:
        found = list(terms)
    if len(found) > MAX_TERMS:
        raise ValueError(f"a vocabulary has at most {MAX_TERMS} terms")
    rows = [(t.translate(_TO_LOWER), k, float(w or 0)) for t, k, w in found if t and k in ("strict", "soft")]
    best: dict[str, tuple[str, float]] = {}
    for t, k, w in sorted(rows, key=lambda r: (r[0], r[1] == "strict", r[2])):
        best[t] = (k, w)
    return [(t, *x) for t, x in best.items()]


def rules_by_host(rules: Iterable[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """Host of a rule to its paths, longest first, each with the rule and its kind."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    for kind, rule in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, kind))
    return {h: sorted(p, key=lambda x: (-len(x[0]), x)) for h, p in out.items()}


def longest_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | tuple[None, None]:
    """Rule and kind: the longest of those of the host and its parents that the path starts with."""
    best, at = None, 0
    while host:
        for start, rule, kind in by_host.get(host[at:], ()):
            if path.startswith(start):
                if best is None or len(rule) >= len(best[0]):
                    best = (rule, kind)
                break
        dot = host.find(".", at)
        if dot < 0:
            break
        at = dot + 1
    return best or (None, None)


def judge(rules: Iterable[tuple[str, str]], terms: list[tuple[str, str, float]], min_soft: int, threshold: float):
    """A pandas UDF: url, host, path -> rule, verdict, strict hits, distinct soft terms, their weight."""
    rules = list(rules)

    @F.pandas_udf("rule string, verdict string, strict_hits int, soft_terms int, soft_weight double")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        by_host, weight = rules_by_host(rules), {t: w for t, k, w in terms if k == "soft"}
        machine = ahocorasick.Automaton()
        for t, kind, _ in terms:
            machine.add_word(t, (kind, t))
        machine.make_automaton()
        for urls, hosts, paths in parts:
            out = []
            for u, host, path in zip(urls, hosts, paths):
                n, seen = 0, set()
                if isinstance(u, str) and terms:
                    u = u.translate(_TO_LOWER)
                    for end, (kind, t) in machine.iter(u):
                        start = end - len(t)
                        if (start < 0 or u[start] not in _INSIDE) and (end + 1 == len(u) or u[end + 1] not in _INSIDE):
                            if kind == "strict":
                                n += 1
                            else:
                                seen.add(t)
                soft = round(sum(weight[t] for t in sorted(seen)), 6)
                rule, verdict = longest_rule(host, path, by_host)
                if verdict is None:
                    verdict = "block" if n or (len(seen) >= min_soft and soft >= threshold) else "allow"
                out.append((rule, verdict, n, len(seen), soft))
            yield pd.DataFrame(out, columns=["rule", "verdict", "strict_hits", "soft_terms", "soft_weight"])

    return judged


def url_filter(pages: DataFrame, rules=RULES, terms=TERMS, min_soft: int = MIN_SOFT, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_terms, soft_weight of every row.

    terms: rows or a table of term, kind (strict or soft), weight.
    """
    host, path = host_and_path(F.col("url"))
    d = pick(pages, "page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judge(rules, vocabulary(terms), min_soft, threshold)("url", "host", "path")
    return d.select("page_id", "host", "path", judged.alias("j")).select("page_id", "host", "path", "j.*")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    def fits(rule: str) -> str:
        h, slash, p = rule.partition("/")
        return f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash}{p}'))"

    cases = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])))
    kinds = " ".join(f"WHEN '{r}' THEN '{k}'" for k, r in RULES)
    one = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"

    def count(t: str) -> str:
        """Places between the parts that the term splits a url into, with no letter or digit beside them."""
        p = f"string_split(u, '{t}')"
        clear = lambda i, side, end: f"(CASE WHEN {p}[{i}] = '' THEN {i} = {end} ELSE NOT regexp_matches({side}({p}[{i}], 1), '[a-z0-9]') END)"
        return f"CASE WHEN contains(u, '{t}') THEN len([i FOR i IN range(1, len({p})) IF {clear('i', 'right', '1')} AND {clear('i + 1', 'left', f'len({p})')}]) ELSE 0 END"

    strict = " + ".join(count(t) for t in STRICT)
    soft = " + ".join(f"CAST({one(t)} AS INT)" for terms in SOFT.values() for t in terms)
    weight = " + ".join(f"CASE WHEN {one(t)} THEN {w} ELSE 0 END" for w, terms in SOFT.items() for t in terms)
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS u,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path, CASE {cases} ELSE NULL END AS rule,
         CAST({strict} AS INT) AS strict_hits, CAST({soft} AS INT) AS soft_terms, round(CAST({weight} AS DOUBLE), 6) AS soft_weight
  FROM parts)
SELECT page_id, host, path, rule,
       CASE rule {kinds} ELSE CASE WHEN strict_hits > 0 OR (soft_terms >= {MIN_SOFT} AND soft_weight >= {THRESHOLD}) THEN 'block' ELSE 'allow' END END AS verdict,
       strict_hits, soft_terms, soft_weight
FROM judged"""


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES = {"op2_url_filter": _oracle()}
