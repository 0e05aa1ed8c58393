"""Queries over events and the star schema: telemetry, feedback, merges, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadweave.functions import names as N
from leadweave.operators import chunks, merge, ranking, sketches
from leadweave.operators import telemetry as T

#: Event types as outcomes of a feedback log.
OUTCOME = {"purchase": "accepted_company", "signup": "contact_found", "view": "homepage_crawled", "click": "search_hit", "error": "unavailable"}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))


def provider_report(spark, sf_dir):
    kind = F.col("event_type")
    r = T.provider_report(_table(spark, sf_dir, "events"), "user_id", "value", error=kind == "error", purchase=kind == "purchase")
    score = T.provider_score(F.col("purchase_rate"), F.lit(0.0), F.lit(0.0), 1 - F.col("error_rate"), F.col("avg_latency"))
    return r.withColumn("score", score).select("user_id", "requests", *[F.bround(c, 9).alias(c) for c in ("error_rate", "purchase_rate", "avg_latency", "median_latency", "p95_latency", "score")])


def merged_reports(spark, sf_dir):
    """provider_report's figures, read from the merged snapshots of three parts of the log."""
    d, kind = _table(spark, sf_dir, "events"), F.col("event_type")
    parts = [sketches.snapshot(d.filter(F.col("event_id") % 3 == i), "user_id", "value", "event_type", error=kind == "error", purchase=kind == "purchase") for i in range(3)]
    r = sketches.report(sketches.merged("user_id", *parts), "user_id")
    return r.select("user_id", "requests", *[F.bround(c, 12).alias(c) for c in ("error_rate", "purchase_rate", "avg_latency", "median_latency", "p95_latency")], "distinct_values")  # 12 places: at 9 means are ties


def rejection_rollup(spark, sf_dir):
    r = T.rejection_report(_table(spark, sf_dir, "events"), F.concat_ws("_", F.when(F.col("value") > 50, F.lit("high")).otherwise(F.lit("low")), "event_type"))
    return r.select("stage", "reason", "n", F.bround("share", 9).alias("share"))


def outcome_points(spark, sf_dir):
    kind = F.lit(None).cast("string")
    for k, v in OUTCOME.items():
        kind = F.when(F.col("event_type") == k, F.lit(v)).otherwise(kind)
    return T.feedback(_table(spark, sf_dir, "events").withColumn("outcome", kind), "user_id", "event_id")


def chunks_of_rows(n: int):
    return Window.partitionBy("user_id", "chunk_").orderBy("ts", "event_id").rowsBetween(1 - n, 0)


def _with_rows(spark, sf_dir, n: int):
    """Events in chunks of a week, each with the n - 1 rows of its user before it."""
    return chunks.with_last_rows(_events(spark, sf_dir), "user_id", ["ts", "event_id"], chunks.chunk_of(F.col("sec"), chunks.SECONDS), n)


def rolling_latency(spark, sf_dir):
    w = chunks_of_rows(20)
    return _with_rows(spark, sf_dir, 20).select("edge_", "event_id", F.bround(T.adaptive_timeout(F.col("value"), w), 6).alias("timeout")).filter("NOT edge_").drop("edge_")


def recent_success(spark, sf_dir):
    """Success ratio over each user's last day."""
    w = Window.partitionBy("user_id", "chunk_").orderBy("sec").rangeBetween(-86_400, 0)
    d = chunks.with_last_seconds(_events(spark, sf_dir), F.col("sec"), 86_400)
    return d.select("edge_", "event_id", F.bround(T.success_ratio(F.col("event_type") != "error", w), 9).alias("ratio")).filter("NOT edge_").drop("edge_")


def budget_window(spark, sf_dir):
    """Whether a user stays under 8 requests in two days."""
    w = Window.partitionBy("user_id", "chunk_").orderBy("sec").rangeBetween(-172_800, 0)
    n = F.count(F.lit(1)).over(w)
    return chunks.with_last_seconds(_events(spark, sf_dir), F.col("sec"), 172_800).select("edge_", "event_id", n.alias("n"), (n <= 8).alias("within")).filter("NOT edge_").drop("edge_")


def health_tier(spark, sf_dir):
    w50, w20 = (chunks_of_rows(n) for n in (50, 20))
    good = (F.col("event_type") != "error").cast("int")
    n50, g50, n20, g20 = F.count(F.lit(1)).over(w50), F.sum(good).over(w50), F.count(F.lit(1)).over(w20), F.sum(good).over(w20)
    d = _with_rows(spark, sf_dir, 50).select("edge_", "event_id", n50.alias("n50"), g50.alias("g50"), n20.alias("n20"), g20.alias("g20"))
    conf = T.blended_confidence(T.beta_confidence(F.col("g50"), F.col("n50")), F.lit(50.0), F.col("n50"))
    return d.filter("NOT edge_").select("event_id", F.bround(conf, 9).alias("confidence"), T.tier(F.col("g20"), F.col("n20"), F.col("n20") - F.col("g20")).alias("tier"))


def failure_streaks(spark, sf_dir):
    e = _events(spark, sf_dir)
    return chunks.failure_streak(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", chunks.chunk_of(F.col("sec"), chunks.SECONDS)).select("event_id", "streak")


def yield_stops(spark, sf_dir):
    w = T.last_rows("user_id", ["ts", "event_id"], 8)
    hit = (F.col("event_type") == "purchase").cast("int")
    return _table(spark, sf_dir, "events").select("event_id", T.yield_stop(hit, w).alias("stop"))


def clamped_fold(spark, sf_dir):
    return T.clamped_fold(_table(spark, sf_dir, "events"), "user_id", "event_id", F.when(F.col("event_type") == "error", -0.5).otherwise(0.5))


def breaker_states(spark, sf_dir):
    return T.breaker_states(_events(spark, sf_dir), "user_id", "event_id", F.col("sec"), F.col("event_type") == "error")


def token_buckets(spark, sf_dir):
    return T.token_bucket(_events(spark, sf_dir), "user_id", "event_id", F.col("sec"), 1 / 36_000, 3.0)


def funnel(spark, sf_dir):
    """Counters of each event type, by day."""
    kinds = ("signup", "view", "click", "purchase", "error")
    return _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


def freshness_scores(spark, sf_dir):
    """Freshness and aged score of each user at the end of the log."""
    d = _events(spark, sf_dir)
    end = d.agg(F.max("sec").alias("end"))  # one row
    u = d.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("sec"))).alias("last"), F.avg("value").alias("base")).join(F.broadcast(end))
    age = (F.col("end") - F.col("last")) / 60
    return u.select("user_id", T.freshness(age).alias("freshness"), F.bround(T.aged(F.col("base"), age / 1440), 6).alias("score"))


def upsert_last_wins(spark, sf_dir):
    """Customers, those divisible by 3 replaced by rows with a new balance."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    old, new = c.withColumn("ord", F.lit(0)), c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1000).withColumn("ord", F.lit(1))
    return merge.upsert(old, new, "c_custkey", "ord")


def best_record_merge(spark, sf_dir):
    """One customer for each nation and segment: the best balance, then arrival; website filled."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("k"), F.floor("c_acctbal").cast("int").alias("relevance_score"), F.lit("google").alias("source"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("https://example.com/"), F.col("c_custkey").cast("string"))).alias("website"), F.lit(None).cast("string").alias("linkedin"))
    return merge.best_record(c, F.col("k")).select("k", "ord", "relevance_score", "website")


def top_k_budget(spark, sf_dir):
    return ranking.top_n(_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 25, F.desc("p_retailprice"), F.col("p_partkey"))


def per_group_top(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return ranking.per_group(p, ["p_brand"], 3, F.desc("p_retailprice"), F.col("p_partkey"))


def title_case(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", N.industry(F.lower("c_mktsegment")).alias("industry"))


def source_top(spark, sf_dir):
    g = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_n(g, 3, F.desc("n"), F.col("event_type"))


def best_and_worst(spark, sf_dir):
    """Best and worst user by share of errors in each event hour."""
    g = _table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour"), "user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("e"))
    return g.groupBy("hour").agg(F.min(F.struct("e", "user_id"))["user_id"].alias("best"), F.max(F.struct("e", (-F.col("user_id")).alias("u")))["u"].alias("w")).select("hour", "best", (-F.col("w")).alias("worst"))


def event_windows(spark, sf_dir):
    """Extension: daily tumbling windows."""
    w = F.window("ts", "1 day")
    return _table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def revenue_by_nation(spark, sf_dir):
    """Extension: star-schema join and aggregation, the reference's relational primitives composed."""
    o, l, c, n = (_table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "nation"))
    l = l.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    d = l.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name").agg(F.count(F.lit(1)).alias("lines"), F.bround(F.sum("rev"), 2).alias("revenue"))


QUERIES = {f.__name__: f for f in (provider_report, merged_reports, rejection_rollup, outcome_points, rolling_latency, recent_success, budget_window, health_tier, failure_streaks, yield_stops, clamped_fold, breaker_states, token_buckets, funnel, freshness_scores, upsert_last_wins, best_record_merge, top_k_budget, per_group_top, title_case, source_top, best_and_worst, event_windows, revenue_by_nation)}

_W20 = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_W50 = _W20.replace("19", "49")
_SEC = "CAST(floor(epoch(ts)) AS BIGINT)"
_POINT = "CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN -2 ELSE 0 END"
ORACLES = {
    # users have fewer events than a sketch keeps whole: its quantiles are exact there
    "merged_reports": """SELECT user_id, count(*) AS requests, round_even(count(*) FILTER (event_type = 'error') / count(*), 12) AS error_rate, round_even(count(*) FILTER (event_type = 'purchase') / count(*), 12) AS purchase_rate, round_even(coalesce(sum(value), 0) / count(*) / 1000, 12) AS avg_latency,
        round_even(coalesce(quantile_disc(value, 0.5), 0) / 1000, 12) AS median_latency, round_even(coalesce(quantile_disc(value, 0.95), 0) / 1000, 12) AS p95_latency, count(DISTINCT event_type) AS distinct_values FROM events GROUP BY user_id""",
    "provider_report": """SELECT user_id, requests, round_even(e, 9) AS error_rate, round_even(p, 9) AS purchase_rate, round_even(a, 9) AS avg_latency, round_even(m, 9) AS median_latency, round_even(q, 9) AS p95_latency,
        round_even(0.5 * p + 0.1 * (1 - e) + 0.05 * greatest(0, 1 - a / 10), 9) AS score FROM (SELECT user_id, count(*) AS requests, avg(CAST(event_type = 'error' AS INT)) AS e, avg(CAST(event_type = 'purchase' AS INT)) AS p,
        sum(value) / count(*) / 1000 AS a, quantile_cont(value, 0.5) / 1000 AS m, quantile_cont(value, 0.95) / 1000 AS q FROM events GROUP BY user_id)""",
    "rejection_rollup": "SELECT stage, stage || '_' || event_type AS reason, count(*) AS n, round_even(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 9) AS share FROM (SELECT CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS stage, event_type FROM events) GROUP BY stage, event_type",
    "outcome_points": f"""SELECT user_id, CAST(sum({_POINT}) AS BIGINT) AS score, count(*) AS queries_run, count(*) FILTER (event_type = 'purchase') AS leads_found, count(*) FILTER (event_type = 'error' AND (last IS NULL OR event_id > last)) AS failures
        FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS last FROM events) GROUP BY user_id""",
    "rolling_latency": f"SELECT event_id, round_even(greatest(6.0, least(20.0, m + 2 * coalesce(s, 0))), 6) AS timeout FROM (SELECT event_id, avg(value) OVER {_W20} AS m, stddev_samp(value) OVER {_W20} AS s FROM events)",
    "recent_success": f"SELECT event_id, round_even(avg(CAST(event_type <> 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 9) AS ratio FROM (SELECT *, {_SEC} AS s FROM events)",
    "budget_window": f"SELECT event_id, n, n <= 8 AS within FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, {_SEC} AS s FROM events))",
    "health_tier": f"""SELECT event_id, round_even(CASE WHEN n50 >= 10 THEN c ELSE c * n50 / 10.0 + 0.5 * (1 - n50 / 10.0) END, 9) AS confidence, CASE WHEN g20 / n20 >= 0.7 THEN 'A' WHEN g20 / n20 >= 0.4 THEN 'B' WHEN n20 > g20 THEN 'C' ELSE 'D' END AS tier
        FROM (SELECT *, (g50 + 1) / (n50 + 2) AS c FROM (SELECT event_id, CAST(count(*) OVER {_W50} AS DOUBLE) AS n50, CAST(sum(CAST(event_type <> 'error' AS INT)) OVER {_W50} AS DOUBLE) AS g50, CAST(count(*) OVER {_W20} AS DOUBLE) AS n20, CAST(sum(CAST(event_type <> 'error' AS INT)) OVER {_W20} AS DOUBLE) AS g20 FROM events))""",
    "failure_streaks": "SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS INT) AS streak FROM (SELECT *, sum(CAST(event_type <> 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)",
    "yield_stops": "SELECT event_id, count(*) OVER w >= 8 AND sum(CAST(event_type = 'purchase' AS INT)) OVER w = 0 AS stop FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)",
    "clamped_fold": """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN event_type = 'error' THEN -0.5 ELSE 0.5 END AS d FROM events),
        f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(1.0 AS DOUBLE) AS w FROM events UNION ALL SELECT f.user_id, e.i, least(50.0, greatest(1.0, f.w + e.d)) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
        SELECT user_id, arg_max(w, i) AS weight, max(i) AS steps FROM f GROUP BY user_id""",
    "funnel": "SELECT CAST(ts AS DATE) AS day, count(*) AS total, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("signup", "view", "click", "purchase", "error")) + " FROM events GROUP BY 1",
    "freshness_scores": f"""SELECT user_id, CAST(CASE WHEN age IS NULL THEN 0.0 WHEN age <= 120 THEN 1.0 WHEN age <= 600 THEN 0.8 WHEN age <= 1800 THEN 0.5 WHEN age <= 3600 THEN 0.2 ELSE 0.0 END AS DOUBLE) AS freshness, round_even(CASE WHEN age IS NULL THEN base * 0.5 ELSE base * pow(0.995, age / 1440) END, 6) AS score
        FROM (SELECT user_id, (max(max({_SEC})) OVER () - max(CASE WHEN event_type = 'purchase' THEN {_SEC} END)) / 60.0 AS age, avg(value) AS base FROM events GROUP BY user_id)""",
    "upsert_last_wins": "SELECT c_custkey, c_name, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1000 ELSE 0 END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS ord FROM customer",
    "best_record_merge": """SELECT k, ord, relevance_score, coalesce(website, first) AS website FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY relevance_score DESC, ord) AS rn, first_value(website IGNORE NULLS) OVER (PARTITION BY k ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first
        FROM (SELECT c_custkey AS ord, c_nationkey || '-' || c_mktsegment AS k, CAST(floor(c_acctbal) AS INT) AS relevance_score, CASE WHEN c_custkey % 4 = 0 THEN 'https://example.com/' || c_custkey END AS website FROM customer)) WHERE rn = 1""",
    "top_k_budget": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25",
    "per_group_top": "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3",
    "title_case": "SELECT c_custkey, CASE WHEN length(c_mktsegment) <= 3 THEN upper(c_mktsegment) ELSE upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) END AS industry FROM customer",
    "source_top": "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3",
    "best_and_worst": "SELECT hour, best, worst FROM (SELECT hour, first_value(user_id) OVER (PARTITION BY hour ORDER BY e, user_id) AS best, first_value(user_id) OVER (PARTITION BY hour ORDER BY e DESC, user_id) AS worst, row_number() OVER (PARTITION BY hour) AS rn FROM (SELECT CAST(hour(ts) AS INT) AS hour, user_id, avg(CAST(event_type = 'error' AS INT)) AS e FROM events GROUP BY 1, 2)) WHERE rn = 1",
    "event_windows": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "revenue_by_nation": "SELECT n_name, count(*) AS lines, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
}

_STEPS = f"e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CAST({_SEC} AS DOUBLE) AS t, event_type = 'error' AS f FROM events)"
ORACLES["breaker_states"] = f"""WITH RECURSIVE {_STEPS},
    s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 'CLOSED' AS st, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS u, CAST(0 AS BIGINT) AS n FROM events UNION ALL
      SELECT user_id, i, CASE WHEN x = 'OPEN' OR o THEN 'OPEN' ELSE 'CLOSED' END, CASE WHEN x = 'OPEN' THEN p WHEN x = 'HALF_OPEN' THEN CASE WHEN f THEN p ELSE 0 END WHEN f THEN p + 4 ELSE greatest(0, p - 1) END, CASE WHEN o THEN t + 600 ELSE u END, n + CAST(o AS BIGINT)
      FROM (SELECT *, f AND (x = 'HALF_OPEN' OR (x = 'CLOSED' AND p + 4 >= 10)) AS o FROM (SELECT s.user_id, e.i, s.p, s.u, s.n, e.t, e.f, CASE WHEN s.st = 'OPEN' AND e.t >= s.u THEN 'HALF_OPEN' ELSE s.st END AS x FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)))
    SELECT user_id, arg_max(st, i) AS state, arg_max(p, i) AS points, arg_max(n, i) AS trips FROM s GROUP BY user_id"""
ORACLES["token_buckets"] = f"""WITH RECURSIVE {_STEPS},
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(3 AS DOUBLE) AS k, min(t) FILTER (i = 1) AS last, CAST(0 AS BIGINT) AS n FROM e GROUP BY user_id UNION ALL
      SELECT user_id, i, CASE WHEN h >= 1 THEN h - 1 ELSE h END, t, n + CAST(h >= 1 AS BIGINT) FROM (SELECT s.user_id, e.i, e.t, s.n, least(3.0, s.k + greatest(0.0, e.t - s.last) * (1 / CAST(36000 AS DOUBLE))) AS h FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
    SELECT user_id, max(i) AS requests, max(n) AS passed FROM s GROUP BY user_id"""
