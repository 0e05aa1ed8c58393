"""Stages of a corpus pipeline: operators whose decisions are applied to the documents.

Each takes documents (doc_id, text, lang, source, n_chars; more columns are passed over)
and returns those columns. Texts are moved once at most, beside one row of decisions for
each document that goes or is repeated.

Null or empty text: an empty document; it is scored as such, equals other empty ones, is near
none, and is never repeated (the mix takes words). Very long texts: whole, in all stages. Null
doc_id: kept unless its quality or an equal text says otherwise; never a near copy. Ties: the
smallest doc_id stays; of rows with one id and one text any one. Repeated rows: one stays after
the copies are dropped; before that each is judged alike, and the mix takes them as documents of
their own. Clashing names among further columns are passed over. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from leadweave.llm.common import SPACE, batch_slices, broadcast_if_small, materialize, numbered, pick, release
from leadweave.llm.exact_dedup import exact_dedup
from leadweave.llm.jaccard_join import jaccard_components
from leadweave.llm.mixing import mix
from leadweave.llm.quality import THRESHOLD, fit, text_scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(docs: DataFrame) -> DataFrame:
    return pick(docs, *COLUMNS, types={"n_chars": LongType()})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose quality reaches the threshold."""
    docs = documents(docs)
    field = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_slices(batches, 1):
            score, *_ = text_scores(field, [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
            yield b.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts.

    Where ids name rows (none is null or repeated) the ids that go are all that is joined; else
    rows are told apart by id and digest.
    """
    docs = documents(docs)
    decided = materialize(exact_dedup(docs), "decided")
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    twice = decided.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count()
    if not twice:
        gone = materialize(decided.filter(~own).select("doc_id"), "gone")
        release(decided)
        return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*COLUMNS)
    gone = decided.filter(~own).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct()
    repeated = decided.filter(own & ~F.col("kept")).limit(1).count() > 0
    digest = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "), 256)
    out = docs.withColumn("sha_", digest)
    out = out.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha_") == F.col("sha")), "left_anti")
    if repeated:  # rows with one id and one text: any of them is the one that stays
        out = out.dropDuplicates(["doc_id", "sha_"])
    return out.select(*COLUMNS)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    docs = documents(docs)
    gone = jaccard_components(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(broadcast_if_small(materialize(gone, "near")), "doc_id", "left_anti").select(*COLUMNS)


def repeat_to_weights(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it.

    Rows equal in all columns are taken together, as often as all of them are.
    """
    docs = documents(docs)
    mixed = mix(docs, by=("text", "lang", "n_chars"))
    taken = mixed.groupBy("doc_id", "source", "key", "rows").agg(F.sum("copies").alias("times")).filter("times > 0")
    taken = materialize(taken, "copies").select(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.col("key").alias("k"), "rows", "times")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("src")) & (F.col("key_") == F.col("k"))
    keyed = docs.withColumn("key_", F.xxhash64("text", "lang", "n_chars"))
    out = keyed.join(taken.filter("rows = 1"), same).select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*COLUMNS)
    if taken.filter("rows > 1").limit(1).count():
        once = keyed.join(taken.filter("rows > 1"), same).groupBy("id", "src", "k").agg(F.any_value("times").alias("times"), *[F.any_value(c).alias(c) for c in COLUMNS])
        out = out.unionByName(numbered(once.select(*COLUMNS, "times"), "times", "number_").select(*COLUMNS))
    return out
