"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

Sources share a multiple of all words by weight, none above a multiple of its own; the
excess is shared again by weight (one water level for all that are not full). Each
document of a source then has the same fraction of copies. Whole copies are given; the
fractions are rounded: a document is paired with the rest of its block, mass (words) is
moved at random from one to the other until one of the two is integral, so the block's
words stay what they were. The largest go first, so what a block can't round is one small
document; these go up a tree of blocks until one document of a source is left, which is
rounded to the nearer side.

Blocks are bounded by a hash of the document and, where rows are equal in id, source and
key, of their number among those, so a source or a repeated row with any share of all rows is
dealt over many tasks; one row goes up for each block. Random numbers are hashes of the
document, so reruns agree.

Sources are few enough for one task to rank them (one row each); documents are not.

Null or empty text: size 0, taken 0. Very long texts: whole; the largest are rounded first.
Null source: a source of its own, the last. A source with no words: target 0. Null doc_id:
as any other. Repeated rows are documents of their own. Ties of size go by a hash. Further
columns, also of clashing names, are passed over. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadweave.llm.common import WORD, broadcast_if_small, materialize, numbered, pick, release

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
DOCS_A_BLOCK, SEED = 512, 20_24


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    s = s.select("*", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("w"))
    cap = F.col("source_size") * F.lit(most)
    s = s.select("*", cap.alias("cap"), (cap / F.col("w")).alias("full"))
    # fullest first: if all before a source are at their cap, this is the level for the rest
    order = Window.orderBy("full", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.select("*", level.alias("level"), F.row_number().over(order).alias("at"))
    found = F.coalesce(F.min_by("level", F.when(F.col("level") <= F.col("full"), F.col("at"))).over(everything), F.lit(float("inf")))
    found = F.when(F.max(F.when(F.col("level") <= F.col("full"), 1)).over(everything).isNull(), F.lit(float("inf"))).otherwise(found)
    return s.select("source", "source_size", F.least("cap", F.col("w") * found).alias("target"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _round_block(items: Column, level: int) -> Column:
    """Items with extra = 0, 1, or null for the one that stays fractional."""
    kind = "array<struct<size:bigint,h:bigint,doc_id:bigint,base:int,key:bigint,rows:bigint,m:double,extra:int>>"
    mass = F.aggregate(items, F.lit(0.0), lambda a, x: a + x["m"])
    size = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["size"])
    start = F.struct(mass.alias("m"), size.alias("s"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        own = F.least(F.greatest(a["m"] * x["size"] / a["s"], F.lit(0.0)), x["size"].cast("double"))
        draw = F.xxhash64(x["h"], x["doc_id"], F.lit(SEED + level)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
        v = F.struct(own.alias("m"), F.greatest(a["m"] - own, F.lit(0.0)).alias("rest"), (a["s"] - x["size"]).alias("room"), draw.alias("u"))

        def move(v: Column) -> Column:
            s = x["size"].cast("double")
            near = F.lit(1e-9) * s
            give, take = F.least(s - v["m"], v["rest"]), F.least(v["m"], F.greatest(v["room"] - v["rest"], F.lit(0.0)))
            to_own = v["u"] * (give + take) < take

            def done(extra: Column, rest: Column, m: Column) -> Column:
                return F.struct(
                    rest.cast("double").alias("m"), v["room"].alias("s"),
                    F.concat(a["out"], F.array(F.struct(*[x[k].alias(k) for k in ("size", "h", "doc_id", "base", "key", "rows")], m.alias("m"), extra.cast("int").alias("extra")))).alias("out"),
                )

            none = F.lit(None).cast("int")
            return (
                F.when(v["m"] <= near, done(F.lit(0), v["rest"], F.lit(0.0)))
                .when(v["m"] >= s - near, done(F.lit(1), v["rest"], s))
                .when(v["room"] == 0, done(none, F.lit(0.0), v["m"]))
                .when(to_own & (s - v["m"] <= v["rest"]), done(F.lit(1), v["rest"] - (s - v["m"]), s))
                .when(to_own, done(none, F.lit(0.0), v["m"] + v["rest"]))
                .when(v["m"] <= v["room"] - v["rest"], done(F.lit(0), v["rest"] + v["m"], F.lit(0.0)))
                .otherwise(done(none, v["room"].cast("double"), v["m"] - (v["room"] - v["rest"])))
            )

        return _let(v, move)

    return F.aggregate(items, start, step, lambda a: a["out"])


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, by: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, source, size, key, rows, source_size, target, copies of every row.

    key: a hash of the columns `by`; rows: how many have this id, source and key.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    cols = pick(docs, "doc_id", "source", *dict.fromkeys(("text", *by)))
    sizes = materialize(cols.select("doc_id", "source", size.alias("size"), F.xxhash64(*by).alias("key")), "mix-sizes")
    count = sizes.count()
    sources = materialize(source_targets(sizes, weights, share, most), "mix-sources")
    groups = sizes.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("rows"))
    rows = groups.alias("d").join(broadcast_if_small(sources).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rate = F.coalesce(F.least(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(most)), F.lit(0.0))
    rows = rows.select("doc_id", "d.source", "size", "key", "rows", "source_size", "target", F.floor(rate + 1e-12).cast("int").alias("base"), rate.alias("rate"))
    part = F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))
    rows = materialize(rows.withColumn("m", F.when(part < 1e-12, 0.0).otherwise(part * F.col("size"))).drop("rate"), "mix-rows")
    release(sizes, sources)
    rows = numbered(rows, "rows", "number")

    whole, common = F.col("m") <= 0, ["source", "source_size", "target"]
    own = ["doc_id", *common, "size", "key", "rows"]
    done = [rows.filter(whole).select(*own, F.col("base").alias("copies"))]
    todo = rows.filter(~whole).withColumn("h", F.xxhash64("doc_id", "size", "key", "number")).drop("number")
    blocks, level = -(-count // DOCS_A_BLOCK), 0
    while True:
        block = F.pmod(F.xxhash64("h", F.lit(level)), F.lit(max(1, blocks)))
        item = F.struct("size", "h", "doc_id", "base", "key", "rows", "m")
        packed = todo.groupBy(*common, block.alias("block")).agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
        out = packed.select(*common, F.explode(_round_block(F.col("items"), level)).alias("x")).select(*common, "x.*")
        out = materialize(out, f"mix-level{level}")
        done.append(out.filter("extra IS NOT NULL").select(*own, (F.col("base") + F.col("extra")).alias("copies")))
        todo = out.filter("extra IS NULL").drop("extra")
        if blocks <= 1:
            break
        blocks, level = -(-blocks // DOCS_A_BLOCK), level + 1
    nearer = F.when(F.col("m") * 2 >= F.col("size"), 1).otherwise(0)
    done.append(todo.select(*own, (F.col("base") + nearer).alias("copies")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "key", "rows", "source_size", "target", "copies")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
