"""Writers: JSON, kept and rejects apart, snapshots that swap, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.sources.readers import _fs


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, where it is
    unset and the master is local, a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/leadweave-scratch"
    return root.rstrip("/")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_split(df: DataFrame, status: str, path: str, kind: str = "parquet") -> None:
    """One pass, a folder for each status."""
    df.write.mode("overwrite").partitionBy(status).format(kind).save(path)


def as_text_columns(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def current_snapshot(spark: SparkSession, path: str) -> str | None:
    """The newest complete snapshot of a table kept by snapshots."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    done = [s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=None)


def write_snapshot(df: DataFrame, path: str) -> str:
    """A new snapshot beside the one that may just be read; readers see whole ones only."""
    last = current_snapshot(df.sparkSession, path)
    n = int(last.rsplit("-", 1)[1]) + 1 if last else 0
    at = f"{path.rstrip('/')}/snapshot-{n:09d}"
    df.write.mode("overwrite").parquet(at)
    return at


def append_remaining(df: DataFrame, path: str) -> None:
    """Log of tasks left over, one JSON line each."""
    df.write.mode("append").json(path)


#: Writers by name.
EXPORTERS = {"json": write_json, "parquet": lambda df, path: df.write.mode("overwrite").parquet(path), "snapshot": write_snapshot, "text_columns": lambda df, path: as_text_columns(df).write.mode("overwrite").parquet(path)}


def report(title: str, rows: DataFrame, most: int = 200) -> str:
    """Fixed-width text of an aggregate; larger tables are refused."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report shows {most} rows at most")
    width = max([len(c) for c in rows.columns] + [24])
    return "\n".join([title, "-" * len(title), *["  ".join(f"{x!s:<{width}}" for x in r) for r in [rows.columns, *got]]])
