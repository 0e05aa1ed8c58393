"""Reports that can be kept and merged: counts, sums and sketches of quantiles and distinct values.

A snapshot is one row an entity. Snapshots of runs, of days or of parts of a log merge into the
snapshot of all of them, in any order; a report is read from a snapshot. Counts, rates and
means are exact. Quantiles come from a KLL sketch and their ranks are off by at most RANK_ERROR
(with 99 % certainty); of up to SKETCH_K samples they are exact. Distinct values come from a
HyperLogLog sketch with a relative standard error of DISTINCT_ERROR. A sketch has a bounded size,
whatever it has seen, and is built before rows are shuffled, so a hot entity is one sketch a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K, DISTINCT_BITS = 800, 12
RANK_ERROR, DISTINCT_ERROR = 0.0056, 0.0163


def snapshot(df: DataFrame, entity: str, latency: str, distinct: str, **classes: Column) -> DataFrame:
    """entity, requests, class counts, milliseconds (sum), samples, latencies and values (sketches).

    latency: milliseconds; null, or not a number, is no sample. distinct: the column whose values are
    counted. A null entity is an entity of its own; an empty table has an empty snapshot.
    """
    d = df.withColumn("_ms", F.when(~F.isnan(F.col(latency).cast("double")), F.col(latency).cast("double")))
    return d.groupBy(entity).agg(
        F.count(F.lit(1)).alias("requests"), *[F.count_if(c).alias(k) for k, c in classes.items()], F.coalesce(F.sum("_ms"), F.lit(0.0)).alias("milliseconds"), F.count("_ms").alias("samples"),
        F.kll_sketch_agg_double("_ms", SKETCH_K).alias("latencies"), F.hll_sketch_agg(F.col(distinct).cast("string"), DISTINCT_BITS).alias("values"),
    )


def merged(entity: str, *snapshots: DataFrame) -> DataFrame:
    """One snapshot of several with the same classes."""
    d = reduce(DataFrame.unionByName, snapshots)
    counts = [c for c in d.columns if c not in (entity, "milliseconds", "latencies", "values")]
    return d.groupBy(entity).agg(*[F.sum(c).alias(c) for c in counts], F.sum("milliseconds").alias("milliseconds"), F.kll_merge_agg_double("latencies", SKETCH_K).alias("latencies"), F.hll_union_agg("values").alias("values")).select(*d.columns)


def report(snapshot: DataFrame, entity: str) -> DataFrame:
    """entity, requests, rates of the classes, mean, median and 95th percentile in seconds (the
    mean divides by all requests; 0 without samples), and the number of distinct values."""
    fixed = (entity, "requests", "milliseconds", "samples", "latencies", "values")
    at = lambda q: F.when(F.col("samples") > 0, F.kll_sketch_get_quantile_double("latencies", F.lit(q)) / 1000).otherwise(0.0)
    return snapshot.select(
        entity, "requests", *[(F.col(c) / F.col("requests")).alias(f"{c}_rate") for c in snapshot.columns if c not in fixed], (F.col("milliseconds") / F.col("requests") / 1000).alias("avg_latency"),
        at(0.5).alias("median_latency"), at(0.95).alias("p95_latency"), F.hll_sketch_estimate("values").alias("distinct_values"),
    )
