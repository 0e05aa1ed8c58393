"""Helpers shared by the training-data operators: column picking, scratch tables."""

from __future__ import annotations

import atexit
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StringType

#: The white space of every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

TYPES = {"doc_id": LongType(), "page_id": LongType(), "vec_id": LongType(), "text": StringType(), "url": StringType(), "lang": StringType(), "source": StringType()}

#: Written tables that still exist: path to session, and table to path.
_made: dict[str, SparkSession] = {}
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def give_back() -> None:
    """In a worker: memory that is free goes back to the system; workers live on between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def pick(df: DataFrame, *names: str, types: dict[str, DataType] | None = None) -> DataFrame:
    """Just these columns, whatever else the table has.

    Columns are taken by position after a rename, so that further columns, even ones
    differing in letter case only or named twice, can't make a name ambiguous. A column
    that the table lacks is null.
    """
    kinds = {**TYPES, **(types or {})}
    have = df.columns
    plain = df.toDF(*[f"_p{i}" for i in range(len(have))])
    out = []
    for n in names:
        at = next((i for i, c in enumerate(have) if c == n), None)
        if at is None:
            at = next((i for i, c in enumerate(have) if c.lower() == n.lower()), None)
        col = F.lit(None) if at is None else F.col(f"_p{at}")
        kind = kinds.get(n)
        if kind is not None and not isinstance(kind, ArrayType):
            col = col.cast(kind)
        out.append(col.alias(n))
    return plain.select(*out)


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset, a folder of this machine is set, but only for a local master: on a
    cluster each host would have another one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/leadweave-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: the lineage ends here.

    An executor lost later costs nothing that was written. The shuffle files of the write
    are not needed any more and go with its end. The table goes with release(), or when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lw-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not _made:
        atexit.register(_clean)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes materialised tables after their last reader; others are passed over."""
    for t in tables:
        path = _path_of.pop(t, None)
        if path is not None:
            _delete(path)


def leftovers() -> set[str]:
    """Paths of the written tables that still exist."""
    return set(_made)


def settled(make, label: str) -> DataFrame:
    """The rows of make() as one written table; the tables that make() wrote itself are gone."""
    before = leftovers()
    out = materialize(make(), label)
    for path in leftovers() - before - {_path_of[out]}:
        _delete(path)
    return out


def _delete(path: str) -> None:
    sc = _made.pop(path).sparkContext
    if sc._jsc is not None:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path in list(_made):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session is already gone
            return


#: Rows and bytes up to which a counted table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A broadcast hint for a materialised table that is small; else the table as it is.

    Beyond the bound the join is a shuffled one, which Spark splits where a key is hot.
    """
    width = sum(max(8, f.dataType.defaultSize() if hasattr(f.dataType, "defaultSize") else 32) for f in table.schema)
    n = table.count()
    return F.broadcast(table) if n <= BROADCAST_ROWS and n * width <= BROADCAST_BYTES else table


def batch_slices(batches, texts: int, size: int = 2 << 20):
    """Parts of Arrow batches whose texts (a column's index) have about this many bytes."""
    import pyarrow.compute as pc

    for b in batches:
        start = total = 0
        for i, n in enumerate(pc.binary_length(b.column(texts)).fill_null(0).to_pylist()):
            total += n + 1
            if total >= size:
                yield b.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)
    give_back()


ROWS_A_CHUNK = 1024


def numbered(groups: DataFrame, count: str, name: str) -> DataFrame:
    """Each row as often as its count says, with its number (from 0) in a column of this name.

    Rows with large counts first become rows for chunks of them, which are dealt anew.
    """
    n, last = F.col(count), F.lit(ROWS_A_CHUNK - 1)
    one = groups.filter(n == 1).withColumn(name, F.lit(0).cast("long"))
    many = groups.filter(n > 1).withColumn("chunk_", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {ROWS_A_CHUNK}"))))
    low = F.col("chunk_") * ROWS_A_CHUNK
    many = many.repartition(*groups.columns, "chunk_").withColumn(name, F.explode(F.sequence(low, F.least(low + last, n - 1)))).drop("chunk_")
    return one.unionByName(many)
