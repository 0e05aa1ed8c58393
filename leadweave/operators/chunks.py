"""Logs of hot entities in chunks: folds that merge, and windows with a carried edge.

One entity may own most of a log, so nothing here gathers or sorts an entity's whole log in one
task. Rows are dealt by (entity, chunk), a chunk being a stretch of the order (ids or seconds);
between chunks only their summaries travel: one function, the last n rows, or a run's length.

A clamped step is x -> min(hi, max(lo, a * x + d)) with a > 0. Two of them one after the other
are a step again, so a chunk's events fold into one step, chunks into one by a tree, and an
entity's state of yesterday needs today's step only. Steps with a = 1 and sums that floats hold
exactly give what the fold one by one gives; others up to the rounding of their products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Span of the order in a chunk (ids), seconds of a chunk, and chunks that one fold of the tree takes.
IDS, SECONDS, FAN = 1 << 18, 7 * 86_400, 1 << 10
INF = float("inf")


def chunk_of(order: Column, size: float) -> Column:
    """Number of the stretch that a row's place (a number or a time in seconds) falls into."""
    return F.floor(order.cast("double") / size).cast("long")


# --- folds ---------------------------------------------------------------------------------------


def step(a: Column | float = 1.0, d: Column | float = 0.0, lo: Column | float = -INF, hi: Column | float = INF) -> Column:
    """The function x -> min(hi, max(lo, a * x + d))."""
    as_ = lambda v, n: (v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n)
    return F.struct(as_(a, "a"), as_(d, "d"), as_(lo, "lo"), as_(hi, "hi"))


def _within(x: Column, s: Column) -> Column:
    return F.least(s["hi"], F.greatest(s["lo"], x))


def applied(s: Column, x: Column) -> Column:
    return _within(s["a"] * x + s["d"], s)


def then(first: Column, second: Column) -> Column:
    """One step for two: the first one's bounds go through the second."""
    return step(second["a"] * first["a"], second["a"] * first["d"] + second["d"], _within(second["a"] * first["lo"] + second["d"], second), _within(second["a"] * first["hi"] + second["d"], second))


def _folded(rows: DataFrame, keys: list[Column], place: str) -> DataFrame:
    """The steps (f) of each group in the order of a column as one, and the sum of their n."""
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("o"), F.col("f")))).alias("s"), F.sum("n").alias("n"))
    return g.withColumn("f", F.aggregate("s", step(), lambda acc, x: then(acc, x["f"]))).drop("s")


def composed(df: DataFrame, entity: str, order: str, each: Column, size: float = IDS) -> DataFrame:
    """entity, f (one step for all of its events in order), n (events). A list holds the events
    of a chunk, or FAN steps of chunks, never an entity's log."""
    d = df.select(F.col(entity), F.col(order).alias("o_"), chunk_of(F.col(order), size).alias("chunk_"), each.alias("f"), F.lit(1).cast("long").alias("n"))
    d = _folded(d, [F.col(entity), F.col("chunk_")], "o_")
    d = _folded(d, [F.col(entity), F.floor(F.col("chunk_") / FAN).alias("part_")], "chunk_")
    return _folded(d, [F.col(entity)], "part_").select(entity, "f", "n")


def merged(old: DataFrame, new: DataFrame, entity: str) -> DataFrame:
    """The state after two logs, the second being the later one; both as composed() gives them."""
    both = old.withColumn("o_", F.lit(0)).unionByName(new.withColumn("o_", F.lit(1)))
    return _folded(both, [F.col(entity)], "o_").select(entity, "f", "n")


# --- windows ----------------------------------------------------------------------------------------


def with_last_rows(df: DataFrame, entity: str, order: list[str], chunk: Column, n: int) -> DataFrame:
    """df with chunk_ and edge_: each chunk also gets the n - 1 rows before it (edge_), as far back
    as they are. Windows of n rows over (entity, chunk_) are then those over the entity; rows
    with edge_ are dropped after them. Chunks must follow the order."""
    d = df.withColumn("chunk_", chunk)
    back = Window.partitionBy(entity, "chunk_").orderBy(*[F.desc(o) for o in order])
    last = d.withColumn("k_", F.row_number().over(back)).filter(F.col("k_") < n)
    row = F.struct(*[F.col(o).alias(f"o{i}_") for i, o in enumerate(order)], F.struct(*df.columns).alias("r"))
    last = last.groupBy(entity, "chunk_").agg(F.array_sort(F.collect_list(row), _by_first(len(order))).alias("rows_"))
    # also chunks with no rows to hand on need those before them: they are rows of this table too
    before = Window.partitionBy(entity).orderBy("chunk_").rowsBetween(1 - n, -1)
    tail = F.slice(F.reverse(F.flatten(F.collect_list("rows_").over(before))), 1, max(1, n - 1))
    carried = last.select(F.col(entity), "chunk_", tail.alias("t")).select("chunk_", F.explode("t").alias("x")).select("x.r.*", "chunk_")
    if n < 2:
        carried = carried.limit(0)
    return d.withColumn("edge_", F.lit(False)).unionByName(carried.withColumn("edge_", F.lit(True)))


def _by_first(k: int):
    """Comparator of structs by their first k fields; the rest may have no order."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in reversed(range(k)):
            out = F.when(a[f"o{i}_"] < b[f"o{i}_"], -1).when(a[f"o{i}_"] > b[f"o{i}_"], 1).otherwise(out)
        return out

    return compare


def with_last_seconds(df: DataFrame, ts: Column, seconds: int, size: int = SECONDS) -> DataFrame:
    """df with chunk_ and edge_: rows of a chunk's last so many seconds are also in the next one, as
    edge_. No join: each row knows by itself. size: seconds of a chunk, not less than the window's."""
    if size < seconds:
        raise ValueError("a chunk must be at least as long as the window")
    own = chunk_of(ts, size)
    late = (own + 1) * size - ts.cast("double") <= seconds
    at = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    d = df.withColumn("own_", own).withColumn("chunk_", F.explode(at))
    return d.withColumn("edge_", F.col("chunk_") > F.col("own_")).drop("own_")


def failure_streak(df: DataFrame, entity: str, order: list[str], failed: Column, chunk: Column, name: str = "streak") -> DataFrame:
    """Length of the run of failures that each row ends (0 at a success). Within chunks by gaps and
    islands; a run that reaches a chunk's start goes on with the run at the end of the one before."""
    d = df.withColumn("f_", F.coalesce(failed, F.lit(False))).withColumn("chunk_", chunk)
    up_to = Window.partitionBy(entity, "chunk_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("i_", F.sum(F.when(F.col("f_"), 0).otherwise(1)).over(up_to))
    run = Window.partitionBy(entity, "chunk_", "i_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("s_", F.sum(F.col("f_").cast("long")).over(run))
    ends = d.groupBy(entity, "chunk_").agg(F.max_by("s_", F.struct(*order)).alias("tail"), F.max(F.when(F.col("f_"), 0).otherwise(1)).alias("broken"))
    by_chunk = Window.partitionBy(entity).orderBy("chunk_")
    ends = ends.withColumn("g", F.sum("broken").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("all", F.sum("tail").over(Window.partitionBy(entity, "g").orderBy("chunk_").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.select(F.col(entity).alias("e_"), F.col("chunk_").alias("c_"), F.coalesce(F.lag("all").over(by_chunk), F.lit(0)).alias("carry_"))
    d = d.join(ends, F.col(entity).eqNullSafe(F.col("e_")) & F.col("chunk_").eqNullSafe(F.col("c_")))
    out = F.col("s_") + F.when(F.col("f_") & (F.col("i_") == 0), F.col("carry_")).otherwise(0)
    return d.withColumn(name, out.cast("int")).select(*df.columns, name)
