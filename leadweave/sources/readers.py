"""Readers: JSON arrays with provenance and rejects, tolerant unions, histories, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.schemas import LEAD


def json_records(spark: SparkSession, paths: str | list[str], schema: str = LEAD) -> tuple[DataFrame, DataFrame]:
    """Records of JSON arrays (files or globs) with their file, and the texts that are no arrays.

    A file is one row here, so it must stay below 2 GB; arrays.json_array_records reads larger
    ones by byte ranges, and takes a broken record alone as a reject.
    """
    d = spark.read.option("wholetext", True).text(paths).select(F.input_file_name().alias("source_file"), F.col("value").alias("raw"))
    array = F.when(F.ltrim("raw").startswith("["), F.from_json("raw", f"array<struct<{_as_fields(schema)}>>", {"mode": "PERMISSIVE"}))
    d = d.withColumn("records", array)
    return d.filter("records IS NOT NULL").select("source_file", F.explode("records").alias("r")).select("r.*", "source_file"), d.filter("records IS NULL").select("source_file", "raw")


def _as_fields(schema: str) -> str:
    """Columns `a string, b array<c:int>` as the fields of a struct."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def latest_file(spark: SparkSession, folder: str, suffix: str = ".json") -> str | None:
    """The file of a folder that changed last, by any file system Spark knows."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return None
    files = [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(suffix)]
    return max(files)[1] if files else None


def union_of_existing(spark: SparkSession, paths: list[str], schema: str = LEAD) -> DataFrame:
    """Records of the inputs that are there, missing columns as nulls."""
    out = spark.createDataFrame([], schema)
    for p in paths:
        if exists(spark, p):
            out = out.unionByName(json_records(spark, p, schema)[0], allowMissingColumns=True)
    return out


def master(spark: SparkSession, path: str) -> DataFrame | None:
    """The master's last snapshot, or None at the first run."""
    from leadweave.sources.sinks import current_snapshot

    at = current_snapshot(spark, path)
    return spark.read.parquet(at) if at else None


def lookup_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database over JDBC; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def search_results(responses: DataFrame, body: str = "body") -> DataFrame:
    """Rows of search responses (JSON text) of any of the usual shapes: position in the list is
    the rank, rows without a URL leave gaps."""
    v = F.try_parse_json(body)
    arrays = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("results", "organic_results", "hits", "data", "items")])
    d = responses.withColumn("_rows", arrays).select("*", F.posexplode("_rows").alias("_i", "_r")).drop("_rows")

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_variant_get("_r", f"$.{n}", "string"), F.lit("")) for n in names])

    out = d.select(*[c for c in responses.columns if c != body], (F.col("_i") + 1).alias("rank"), first("url", "link", "href", "uri").alias("url"), first("title", "name", "heading").alias("title"), F.substring(first("snippet", "description", "body", "summary", "extract"), 1, 400).alias("snippet"))
    return out.filter("url IS NOT NULL")


def csv_records(spark: SparkSession, *paths: str, **options: str) -> DataFrame:
    """CSV files with a header; all columns are text unless a schema is given as an option."""
    schema = options.pop("schema", None)
    r = spark.read.options(header="true", **options)
    return (r.schema(schema) if schema else r).csv(list(paths))


def recorded_search(tasks: DataFrame, responses: DataFrame, pages: int = 1) -> DataFrame:
    """Rows of recorded answers (source, query, page, body) to search tasks (source, query): the
    first pages of each. Live providers write such a table; nothing is fetched here."""
    asked = tasks.select("source", "query").distinct()
    return search_results(responses.filter(F.col("page") <= pages).join(asked, ["source", "query"], "left_semi"))
