"""Health, yield and feedback over outcome logs (entity, ord, ts, outcome, latency).

Clamped weights, scores and rates fold by chunks, and windows and streaks have versions over
chunks of an entity's log (see chunks.py). Breakers and buckets are machines with a clock whose
steps don't compose: batch runs them over an entity's ordered events in one row (some 24 bytes
each, so some ten million events), streaming keeps their state (streaming/state.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.functions import values as V
from leadweave.operators import chunks

#: Points of an outcome, and outcomes that count as failures.
POINTS = {"accepted_company": 5, "contact_found": 3, "homepage_crawled": 2, "search_hit": 1, "zero_result": -1, "unavailable": -2, "captcha": -3, "parser_failure": 0}
FAILING = ("zero_result", "unavailable", "captcha")
#: Seconds since the last success, and freshness.
FRESHNESS = ((120, 1.0), (600, 0.8), (1800, 0.5), (3600, 0.2))


def last_rows(entity: str, order: list[str], n: int) -> Window:
    return Window.partitionBy(entity).orderBy(*order).rowsBetween(1 - n, 0)


def last_seconds(entity: str, ts: Column, seconds: int) -> Window:
    return Window.partitionBy(entity).orderBy(ts).rangeBetween(-seconds, 0)


def adaptive_timeout(latency: Column, w: Window, low: float = 6.0, high: float = 20.0) -> Column:
    """Mean and two sample deviations of the last latencies, within bounds."""
    spread = F.when(F.count(latency).over(w) < 2, F.lit(0.0)).otherwise(F.stddev_samp(latency).over(w))
    return F.greatest(F.lit(low), F.least(F.lit(high), F.avg(latency).over(w) + 2.0 * spread))


def success_ratio(success: Column, w: Window) -> Column:
    return F.avg(success.cast("double")).over(w)


def freshness(age: Column) -> Column:
    """Step decay of the seconds since the last success; null: 0."""
    out = F.lit(0.0)
    for limit, value in reversed(FRESHNESS):
        out = F.when(age <= limit, F.lit(value)).otherwise(out)
    return F.when(age.isNull(), F.lit(0.0)).otherwise(out)


def aged(score: Column, days: Column) -> Column:
    return F.when(days.isNull(), score * 0.5).otherwise(score * F.pow(F.lit(0.995), days))


def beta_confidence(successes: Column, total: Column) -> Column:
    """Mean of a Beta(1, 1) prior's posterior; null without observations."""
    return F.when(total > 0, (successes + 1) / (total + 2))


def blended_confidence(confidence: Column, score: Column, observations: Column, least: int = 10, top: float = 100.0) -> Column:
    """Short-term confidence, blended with the long-term score until there are enough observations."""
    w = observations / F.lit(least)
    return F.when(confidence.isNull(), score / top).when(observations >= least, confidence).otherwise(confidence * w + score / top * (1 - w))


def tier(good: Column, total: Column, failing: Column) -> Column:
    """A to E from the last observations."""
    ratio = good / total
    return F.when(total == 0, F.lit("E")).when(ratio >= 0.7, F.lit("A")).when(ratio >= 0.4, F.lit("B")).when(failing > 0, F.lit("C")).otherwise(F.lit("D"))


def derived_score(confidence: Column, ratio: Column, fresh: Column, base: Column, days: Column) -> Column:
    return F.greatest(F.lit(0.001), aged(0.50 * confidence + 0.25 * ratio + 0.15 * fresh + 0.10 * base, days))


def failure_streak(df: DataFrame, entity: str, order: list[str], failed: Column, name: str = "streak") -> DataFrame:
    """Length of the run of failures that each row ends (0 at a success): gaps and islands."""
    before = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_f", F.coalesce(failed, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(before))
    run = Window.partitionBy(entity, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.sum(F.col("_f").cast("int")).over(run).cast("int")).drop("_f", "_island")


def yield_stop(hits: Column, w: Window) -> Column:
    """Whether a full window of queries brought nothing."""
    return (F.count(hits).over(w) >= 8) & (F.sum(hits).over(w) == 0)


def feedback(df: DataFrame, key: str, order: str, outcome: str = "outcome", results: str | None = None) -> DataFrame:
    """Score, runs, leads and failures since the last accepted one, of each key."""
    o = F.col(outcome)
    points = F.lit(0)
    for k, v in POINTS.items():
        points = F.when(o == k, F.lit(v)).otherwise(points)
    if results:
        points = F.when((o == "search_hit") & (F.col(results) > 0), F.least(F.col(results), F.lit(10))).otherwise(points)
    accept = F.max(F.when(o == "accepted_company", F.col(order))).over(Window.partitionBy(key))
    d = df.withColumn("_points", points).withColumn("_last", accept)
    after = F.col("_last").isNull() | (F.col(order) > F.col("_last"))
    return d.groupBy(key).agg(F.sum("_points").cast("long").alias("score"), F.count(F.lit(1)).alias("queries_run"), F.count_if(o == "accepted_company").alias("leads_found"), F.count_if(o.isin(*FAILING) & after).alias("failures"))


def _recovering(days: Column) -> Column:
    """Weight after many failures: close to none at first, back with time."""
    return F.greatest(F.lit(0.001), 1 - 0.999 * F.exp(-0.02 * days))


def feedback_weight(failures: Column, days: Column, template_runs: Column, template_score: Column, template_failures: Column, template_days: Column) -> Column:
    """Weight of a query: low after 30 failures of its own or 50 of its template (days: since the
    last run), else by the template's points for each run; 1 without a template's history."""
    roi = template_score / F.nullif(template_runs, F.lit(0))
    by_roi = F.greatest(F.lit(0.2), F.least(F.lit(2.0), 1 + 0.1 * roi))
    return F.when(failures >= 30, _recovering(days)).when(F.coalesce(template_runs, F.lit(0)) <= 0, F.lit(1.0)).when(template_failures >= 50, _recovering(template_days)).otherwise(by_roi)


def template_report(df: DataFrame, template: Column, outcome: str = "outcome", n: int = 10) -> DataFrame:
    """template, runs, leads, roi: the n templates with the most leads for each run."""
    g = df.withColumn("template", template).filter("template IS NOT NULL").groupBy("template").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col(outcome) == "accepted_company").alias("leads"))
    return g.withColumn("roi", F.col("leads") / F.col("runs")).orderBy(F.desc("roi"), "template").limit(n)


def source_ratings(feedback_: DataFrame, key: str) -> DataFrame:
    """key, score (points for each run), stars (1 to 5), queries_run; from feedback()."""
    score = F.coalesce(F.col("score") / F.nullif(F.col("queries_run"), F.lit(0)), F.lit(0.0))
    stars = F.when(score >= 3, 5).when(score >= 1, 4).when(score >= 0, 3).when(score >= -1, 2).otherwise(1)
    return feedback_.select(key, score.alias("score"), stars.alias("stars"), "queries_run")


def parser_report(df: DataFrame, parser: str, succeeded: Column, millis: str) -> DataFrame:
    """parser, successes, failures, success_rate, avg_time_ms (of successes)."""
    ok = F.coalesce(succeeded, F.lit(False))
    g = df.groupBy(parser).agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.sum(F.when(ok, F.col(millis))).alias("_t"))
    rate, mean = F.col("successes") / (F.col("successes") + F.col("failures")), F.coalesce(F.col("_t") / F.nullif(F.col("successes"), F.lit(0)), F.lit(0.0))
    return g.select(parser, "successes", "failures", rate.alias("success_rate"), mean.alias("avg_time_ms"))


def best_and_worst_parser(report: DataFrame, parser: str) -> DataFrame:
    """best, worst (by success rate, the first by name of equal ones) and the mean time of all successes."""
    name, rate = F.col(parser), F.col("success_rate")
    return report.agg(
        F.min(F.struct((-rate).alias("r"), name.alias("n")))["n"].alias("best"), F.min(F.struct(rate.alias("r"), name.alias("n")))["n"].alias("worst"),
        F.coalesce(F.sum(F.col("successes") * F.col("avg_time_ms")) / F.nullif(F.sum("successes"), F.lit(0)), F.lit(0.0)).alias("avg_parse_ms"),
    )


def exploring_score(queries: Column, leads: Column, accepted: Column, succeeded: Column, failures: Column, latency: Column, cost: Column) -> Column:
    """Score 1 to 100 of a provider: yield, acceptance, success, speed and safety, a bonus while
    it has few queries, less for what it costs; 100 without queries."""
    of = lambda c: c / queries * 100.0
    base = 0.35 * of(leads) + 0.20 * of(accepted) + 0.10 * of(succeeded) + 0.25 * F.greatest(F.lit(0.0), 100.0 - latency * 8.0) + 0.10 * F.greatest(F.lit(0.0), 100.0 - of(failures))
    base = F.when(queries < 3, F.greatest(F.lit(20.0), base)).otherwise(base)
    score = base + 15.0 / F.sqrt(queries) - F.when(cost > 0, 20.0 * cost).otherwise(0.0)
    return F.when(F.coalesce(queries, F.lit(0)) == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(100.0), score)))


def balance_score(alive: Column, score: Column, requests: Column, successes: Column, failures: Column, megabytes: Column, blocked: Column) -> Column:
    """Scheduling score of a worker: health, score of its route, success, less failures and memory."""
    rate = F.when(requests > 0, successes / requests).otherwise(1.0)
    memory = F.when(megabytes > 300, F.least(megabytes / 300.0 - 1.0, F.lit(1.0))).otherwise(0.0)
    out = 0.30 * F.when(alive, 1.0).otherwise(0.0) + 0.25 * score / 100.0 + 0.25 * rate - 0.10 * F.least(failures * 0.2, F.lit(1.0)) - 0.10 * memory
    return F.when(blocked, F.lit(0.0)).otherwise(out)


def provider_report(df: DataFrame, entity: str, latency: str, **classes: Column) -> DataFrame:
    """Requests, rates by class, and mean, median and 95th percentile of the latency in
    seconds. The mean divides by all requests, the percentiles use samples only."""
    reqs = F.count(F.lit(1))
    return df.groupBy(entity).agg(
        reqs.alias("requests"), *[(F.count_if(c) / reqs).alias(f"{k}_rate") for k, c in classes.items()], (F.coalesce(F.sum(latency), F.lit(0.0)) / reqs / 1000).alias("avg_latency"),
        (F.coalesce(F.percentile(latency, F.lit(0.5)), F.lit(0.0)) / 1000).alias("median_latency"), (F.coalesce(F.percentile(latency, F.lit(0.95)), F.lit(0.0)) / 1000).alias("p95_latency"),
    )


def provider_score(accepted: Column, homepages: Column, parser: Column, http: Column, avg_latency: Column) -> Column:
    return 0.50 * accepted + 0.20 * homepages + 0.15 * parser + 0.10 * http + 0.05 * F.greatest(F.lit(0.0), 1.0 - avg_latency / 10.0)


def rejection_report(df: DataFrame, reason: Column) -> DataFrame:
    """Counts by stage (what stands before the first underscore) and reason, and shares of all."""
    g = df.select(F.substring_index(reason, "_", 1).alias("stage"), reason.alias("reason")).groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("_total"))  # one row
    return g.join(F.broadcast(total)).select("stage", "reason", "n", (F.col("n") / F.col("_total")).alias("share"))


def clamped_fold(df: DataFrame, entity: str, order: str, delta: Column, start: float = 1.0, low: float = 1.0, high: float = 50.0) -> DataFrame:
    """Weight of each entity after its steps in order, kept within bounds after each."""
    g = chunks.composed(df, entity, order, chunks.step(1.0, F.coalesce(delta, F.lit(0.0)), low, high))
    return g.select(entity, chunks.applied(F.col("f"), F.lit(start)).alias("weight"), F.col("n").alias("steps"))


def breaker_states(df: DataFrame, entity: str, order: str, ts: Column, failed: Column, points: float = 4.0, limit: float = 10.0, cooldown: int = 600) -> DataFrame:
    """Scored circuit breaker over each entity's events (ts in seconds): failures add points,
    successes take one; at the limit it opens, after the cooldown one probe decides."""
    g = df.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), ts.cast("double").alias("t"), F.coalesce(failed, F.lit(False)).alias("f")))).alias("e"))
    start = F.struct(F.lit("CLOSED").alias("s"), F.lit(0.0).alias("p"), F.lit(0.0).alias("until"), F.lit(0).cast("long").alias("trips"))

    def state(s, p, until, trips):
        return F.struct(s.alias("s"), p.cast("double").alias("p"), until.cast("double").alias("until"), trips.cast("long").alias("trips"))

    def step(a: Column, x: Column) -> Column:
        now = F.when((a["s"] == "OPEN") & (x["t"] >= a["until"]), F.lit("HALF_OPEN")).otherwise(a["s"])
        opened = state(F.lit("OPEN"), a["p"], x["t"] + cooldown, a["trips"] + 1)
        more = a["p"] + points
        closed = F.when(x["f"] & (more >= limit), state(F.lit("OPEN"), more, x["t"] + cooldown, a["trips"] + 1)).when(x["f"], state(F.lit("CLOSED"), more, a["until"], a["trips"])).otherwise(state(F.lit("CLOSED"), F.greatest(F.lit(0.0), a["p"] - 1), a["until"], a["trips"]))
        return F.when(now == "HALF_OPEN", F.when(x["f"], opened).otherwise(state(F.lit("CLOSED"), F.lit(0.0), a["until"], a["trips"]))).when(now == "OPEN", a).otherwise(closed)

    return g.select(entity, F.aggregate("e", start, step).alias("b")).select(entity, F.col("b.s").alias("state"), F.col("b.p").alias("points"), F.col("b.trips").alias("trips"))


def _events_of(df: DataFrame, entity: str, order: str, **fields: Column) -> DataFrame:
    """entity, _log: its events in order, one array."""
    e = F.struct(F.col(order).alias("o"), *[c.alias(k) for k, c in fields.items()])
    return df.groupBy(entity).agg(F.array_sort(F.collect_list(e)).alias("_log"))


def score_fold(df: DataFrame, entity: str, order: str, outcome: Column, start: float = 100.0) -> DataFrame:
    """entity, score (0 to 100), events: points of each outcome in order, kept within bounds after each."""
    step = F.lit(V.SCORE_STEP)
    for k, v in V.SCORE_STEPS.items():
        step = F.when(outcome == k, F.lit(v)).otherwise(step)
    g = chunks.composed(df, entity, order, chunks.step(1.0, step, 0.0, 100.0))
    return g.select(entity, chunks.applied(F.col("f"), F.lit(start)).alias("score"), F.col("n").alias("events"))


def ratio_breaker(df: DataFrame, entity: str, order: str, ts: Column, failed: Column, window: int = 20, least: int = 6, share: float = 0.8, waits: tuple[int, ...] = (60, 120, 300, 600), probes: int = 2) -> DataFrame:
    """entity, state (CLOSED, OPEN, PROBE), opens, backoff: opens when so large a share of the last
    outcomes failed; after the wait, so many successes in a row close it and a failure opens it
    for the next longer wait. Events while it is open don't count. ts: seconds."""
    g = _events_of(df, entity, order, t=ts.cast("double"), f=F.coalesce(failed, F.lit(False)))
    none = F.array().cast("array<boolean>")
    wait = lambda k: F.element_at(F.array(*[F.lit(float(w)) for w in waits]), F.least(k + 1, F.lit(len(waits))).cast("int"))

    def state(until, probing, good, step, opens, last):
        return F.struct(until.cast("double").alias("until"), probing.alias("probing"), good.cast("int").alias("good"), step.cast("int").alias("step"), opens.cast("long").alias("opens"), last.alias("last"))

    def fold(a: Column, x: Column) -> Column:
        shut = x["t"] < a["until"]
        probing = a["probing"] | ((a["until"] > 0) & ~shut)
        good = F.when(a["probing"], a["good"]).otherwise(0)
        last = F.slice(F.concat(F.array(x["f"]), a["last"]), 1, window)
        full = F.size(last) >= least
        bad = F.size(F.filter(last, lambda y: y)) / F.size(last) >= share
        closed = state(F.lit(0.0), F.lit(False), F.lit(0), F.lit(0), a["opens"], none)
        again = state(x["t"] + wait(a["step"] + 1), F.lit(False), F.lit(0), a["step"] + 1, a["opens"] + 1, a["last"])
        opened = state(x["t"] + wait(a["step"]), F.lit(False), F.lit(0), a["step"], a["opens"] + 1, last)
        more = state(a["until"], F.lit(True), good + 1, a["step"], a["opens"], a["last"])
        on = state(a["until"], F.lit(False), F.lit(0), a["step"], a["opens"], last)
        return F.when(shut, a).when(probing, F.when(x["f"], again).when(good + 1 >= probes, closed).otherwise(more)).when(full & bad, opened).otherwise(on)

    start = state(F.lit(0.0), F.lit(False), F.lit(0), F.lit(0), F.lit(0), none)
    b = F.aggregate("_log", start, fold)
    kind = F.when(F.col("b.probing"), F.lit("PROBE")).when(F.col("b.until") > F.col("end"), F.lit("OPEN")).when(F.col("b.until") > 0, F.lit("PROBE")).otherwise(F.lit("CLOSED"))
    return g.select(entity, b.alias("b"), F.element_at("_log", -1)["t"].alias("end")).select(entity, kind.alias("state"), F.col("b.opens").alias("opens"), F.col("b.step").alias("backoff"))


def streak_breaker(df: DataFrame, entity: str, order: str, ts: Column, failed: Column, limit: int, cooldown: float, restart: bool = False) -> DataFrame:
    """entity, opens, skipped, streak: opens at so many failures in a row for a while; events
    while it is open are skipped. restart: whether the count starts anew after the wait (else
    the next failure opens it again). ts: seconds."""
    g = _events_of(df, entity, order, t=ts.cast("double"), f=F.coalesce(failed, F.lit(False)))

    def fold(a: Column, x: Column) -> Column:
        shut = x["t"] < a["until"]
        before = F.when(F.lit(restart) & (a["until"] > 0) & ~shut, 0).otherwise(a["n"])
        n = F.when(x["f"], before + 1).otherwise(0)
        trip = x["f"] & (n >= limit)
        until = F.when(trip, x["t"] + cooldown).when(F.lit(restart), F.lit(0.0)).otherwise(a["until"])
        return F.struct(F.when(shut, a["n"]).otherwise(n).alias("n"), F.when(shut, a["until"]).otherwise(until).alias("until"), (a["opens"] + (trip & ~shut).cast("long")).alias("opens"), (a["skipped"] + shut.cast("long")).alias("skipped"))

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("until"), zero.alias("opens"), zero.alias("skipped"))
    return g.select(entity, F.aggregate("_log", start, fold).alias("b")).select(entity, F.col("b.opens").alias("opens"), F.col("b.skipped").alias("skipped"), F.col("b.n").alias("streak"))


def throttle_fold(df: DataFrame, entity: str, order: str, status: Column, blocked: Column, seconds: Column, start: float = 1.0) -> DataFrame:
    """entity, rate: requests a second after each answer in order: less after refusals, blocks and
    slow answers, a little more after fast ones, within bounds."""
    S = chunks.step
    each = F.when(status == 429, S(0.4, lo=0.05)).when(blocked, S(0.5, lo=0.05)).when(seconds > 2.0, S(0.8, lo=0.1)).when(seconds < 0.8, S(1.1, hi=2.0)).otherwise(S())
    return chunks.composed(df, entity, order, each).select(entity, chunks.applied(F.col("f"), F.lit(start)).alias("rate"))


def snapshot(df: DataFrame, entity: str, order: str, outcome: str, keep: int = 50) -> DataFrame:
    """entity, events, by_outcome (map of counts), last (its last outcomes in order): the state
    that a restart needs. Blocks and cooldowns are not part of it: they start anew."""
    n = Window.partitionBy(entity).orderBy(F.desc(order))
    last = df.withColumn("_n", F.row_number().over(n)).filter(F.col("_n") <= keep).groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(outcome).alias("x")))), lambda r: r["x"]).alias("last"))
    counts = df.groupBy(entity, outcome).agg(F.count(F.lit(1)).alias("n")).groupBy(entity).agg(F.sum("n").alias("events"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(outcome).alias("k"), F.col("n").alias("v"))))).alias("by_outcome"))
    return counts.join(last, entity)


def token_bucket(df: DataFrame, entity: str, order: str, ts: Column, rate: float, burst: float) -> DataFrame:
    """Requests let through by a bucket that fills at a rate up to a burst."""
    g = df.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), ts.cast("double").alias("t")))).alias("e"))

    def step(a: Column, x: Column) -> Column:
        have = F.least(F.lit(burst), a["tokens"] + F.greatest(F.lit(0.0), x["t"] - F.coalesce(a["t"], x["t"])) * rate)
        go = have >= 1
        return F.struct(F.when(go, have - 1).otherwise(have).alias("tokens"), x["t"].alias("t"), (a["passed"] + go.cast("long")).alias("passed"))

    start = F.struct(F.lit(burst).cast("double").alias("tokens"), F.lit(None).cast("double").alias("t"), F.lit(0).cast("long").alias("passed"))
    return g.select(entity, F.size("e").cast("long").alias("requests"), F.aggregate("e", start, step)["passed"].alias("passed"))


def quarantine_seconds(step: Column, table: tuple[int, ...] = (30, 60, 120, 300)) -> Column:
    return F.element_at(F.array(*map(F.lit, table)), F.least(step + 1, F.lit(len(table))).cast("int"))


def still_valid(ts: Column, as_of: Column, seconds: int) -> Column:
    return F.unix_seconds(as_of) - F.unix_seconds(ts) < seconds


def search_report(df: DataFrame, provider: str, results: Column, accepted: Column, merged: Column, millis: str, **outcomes: Column) -> DataFrame:
    """provider, searches, results, merged, accepted, yield (accepted for each search), counts of the
    outcomes, and mean, median and 95th percentile of the time: the whole of a search run, by provider."""
    n = F.count(F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return df.groupBy(provider).agg(
        n.alias("searches"), total(results).alias("results"), total(merged).alias("merged"), total(accepted).alias("accepted"), (F.coalesce(F.sum(accepted), F.lit(0)) / n).alias("yield"), *[F.count_if(c).alias(k) for k, c in outcomes.items()],
        F.coalesce(F.avg(millis), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.percentile(millis, F.lit(0.5)), F.lit(0.0)).alias("median_ms"), F.coalesce(F.percentile(millis, F.lit(0.95)), F.lit(0.0)).alias("p95_ms"),
    )
