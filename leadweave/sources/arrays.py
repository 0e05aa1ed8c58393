"""JSON arrays of any size, read by many tasks: a file is cut into byte ranges.

Where a range starts, one can't see whether that is inside a string or how deep. So each range is
read twice. First it tells its number of quotes and how much deeper it ends, once for a start
inside a string and once for one outside; prefix sums over a file's ranges (one small row each)
then tell each range's true start. Second, each range gives the elements of the array whose
opening bracket or comma lies in it, reading on past its end to finish the last one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadweave.schemas import LEAD

SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20
_DEPTH = np.zeros(256, dtype=np.int8)
_DEPTH[[ord("["), ord("{")]] = 1
_DEPTH[[ord("]"), ord("}")]] = -1


def _open(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", re.sub("^file:/+", "file:///", path)))
    return system.open_input_file(place)


def _escaped_start(f, at: int) -> bool:
    """Whether an odd number of backslashes stands before a place."""
    n = 0
    while at > 0:
        f.seek(max(0, at - 4096))
        b = f.read(min(4096, at))
        run = len(b) - len(b.rstrip(b"\\"))
        n, at = n + run, at - len(b)
        if run < len(b):
            break
    return n % 2 == 1


def _scan(b: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Quotes before and at each byte that open or end a string; whether what follows is escaped."""
    slash = np.flatnonzero(b == 92)
    quote = b == 34
    if escaped and len(b):
        quote[0] = False
    if len(slash):
        # runs of backslashes: those at odd places of a run escape what follows them
        new = np.r_[True, np.diff(slash) > 1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(slash)), 0))
        place = slash - slash[first]
        if escaped and slash[0] == 0:
            place = np.where(first == 0, place + 1, place)
        acts = slash[place % 2 == 0]
        quote[acts[acts + 1 < len(b)] + 1] = False
        after = len(acts) > 0 and int(acts[-1]) == len(b) - 1
    else:
        after = escaped and len(b) == 0
    return np.cumsum(quote, dtype=np.int64), after


def _parts(f, start: int, stop: int | None) -> Iterator[tuple[int, np.ndarray]]:
    f.seek(start)
    while stop is None or start < stop:
        raw = f.read(READ_BYTES if stop is None else min(READ_BYTES, stop - start))
        if not raw:
            return
        yield start, np.frombuffer(raw, dtype=np.uint8)
        start += len(raw)


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each range: quotes, and the change of depth outside strings for both starts."""
    for d in batches:
        rows = []
        for path, start, stop in zip(d["path"], d["start"], d["stop"]):
            quotes, out, inside = 0, 0, 0
            with _open(path) as f:
                escaped = _escaped_start(f, start)
                for _, b in _parts(f, start, stop):
                    n, escaped = _scan(b, escaped)
                    odd, depth = (n + quotes) % 2, _DEPTH[b].astype(np.int64)
                    out, inside = out + int(depth[odd == 0].sum()), inside + int(depth[odd == 1].sum())
                    quotes += int(n[-1])
            rows.append((path, start, stop, quotes, out, inside))
        yield pd.DataFrame(rows, columns=["path", "start", "stop", "quotes", "out", "inside"])


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The elements that begin in each range, and file texts that are no array (at -1)."""
    for d in batches:
        for path, start, stop, quotes, depth in zip(d["path"], d["start"], d["stop"], d["quotes"], d["depth"]):
            found: list[tuple[str, int, str]] = []
            with _open(path) as f:
                if start == 0:
                    head = b"".join(b.tobytes() for _, b in _parts(f, 0, 4096)).removeprefix(b"\xef\xbb\xbf").lstrip()
                    if not head.startswith(b"["):
                        found.append((path, -1, head.decode("utf-8", "replace")))
                escaped, begin, held = _escaped_start(f, start), None, []
                done = False
                for at, b in _parts(f, start, None):
                    n, escaped = _scan(b, escaped)
                    outside = (n + quotes) % 2 == 0
                    step = np.where(outside, _DEPTH[b], 0).astype(np.int64)
                    level = depth + np.cumsum(step)
                    opens = outside & (b == 91) & (level == 1)
                    comma = outside & (b == 44) & (level == 1)
                    close = outside & (b == 93) & (level == 0)
                    last = 0
                    for i in np.flatnonzero(opens | comma | close).tolist():
                        if begin is not None:
                            text = b"".join([*held, b[last:i].tobytes()]).strip()
                            held = []
                            if text or comma[i]:
                                found.append((path, begin, text.decode("utf-8", "replace")))
                            begin = None
                        if not close[i] and at + i < stop:
                            begin, last = at + i + 1, i + 1
                        if at + i >= stop:
                            done = True
                            break
                    if done:
                        break
                    if begin is not None:
                        held.append(b[last:].tobytes())
                    elif at + len(b) >= stop:
                        break
                    quotes, depth = quotes + int(n[-1]), int(level[-1])
                    if found:
                        yield pd.DataFrame(found, columns=["source_file", "at", "raw"])
                        found = []
                if begin is not None and not done and b"".join(held).strip():  # the array has no end
                    found.append((path, begin, b"".join(held).strip().decode("utf-8", "replace")))
            if found:
                yield pd.DataFrame(found, columns=["source_file", "at", "raw"])


def elements(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """source_file, at (byte where it begins), raw: the elements of JSON arrays, in any order; a
    file that is no array gives its first 4 KB with at = -1. Empty files and arrays give nothing."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length").filter("length > 0")  # lengths only: contents aren't read
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("stop"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = lambda d: d.repartition(tasks, "path", "start")
    seen = spread(ranges).mapInPandas(_survey, "path string, start long, stop long, quotes long, out long, inside long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    seen = seen.withColumn("step", F.when(F.col("before") == 0, F.col("out")).otherwise(F.col("inside")))
    seen = seen.select("path", "start", "stop", F.col("before").alias("quotes"), F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"))
    return spread(seen).mapInPandas(_elements, "source_file string, at long, raw string")


def json_array_records(spark: SparkSession, paths: str | list[str], schema: str = LEAD, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Records of JSON arrays with source_file and at, and rejects (source_file, at, raw).

    An element that is no object, or doesn't fit the schema, is one reject, as is a file that is
    no array; the others of its file are kept. A record with an unmatched quote or bracket
    takes those after it along, until it is matched. Missing fields are null, others are passed over. One
    element must fit a row (2 GB), the file needn't.
    """
    names = [f"`{n}`" for n in _names(schema)]
    d = elements(spark, paths, split_bytes)
    r = F.from_json("raw", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = d.withColumn("r", F.when((F.col("at") >= 0) & F.col("raw").startswith("{"), r))
    good = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    return d.filter(good).select(*[F.col(f"r.{n}") for n in names], "source_file", "at"), d.filter(~good).select("source_file", "at", "raw")


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names


def _bracketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    comma = ""
    yield pd.DataFrame({"value": ["["]})
    for d in batches:
        rows = d["value"].tolist()
        if rows:
            yield pd.DataFrame({"value": [comma + rows[0], *("," + r for r in rows[1:])]})
            comma = ","
    yield pd.DataFrame({"value": ["]"]})


def write_arrays(df: DataFrame, path: str, element: Column | None = None) -> None:
    """The rows (or the given texts of them) as JSON arrays, one file a task, each written as it
    streams by."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}) if element is None else element
    df.select(text.alias("value")).mapInPandas(_bracketed, "value string").write.mode("overwrite").text(path)
