"""Batch readers for the source types, and facts about what they return."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.config import Source

# Types whose rows sit in files, with the Spark format that reads them.
FILE_FORMATS = {
    "csv": "csv", "http": "csv", "parquet": "parquet", "s3": "parquet", "json": "json",
    "ndjson": "json", "rest": "json", "sse": "json", "delta": "delta", "iceberg": "iceberg",
}
JDBC_DRIVERS = {
    "postgres": ("postgresql", "org.postgresql.Driver"),
    "mysql": ("mysql", "com.mysql.cj.jdbc.Driver"),
    "duckdb": ("duckdb", "org.duckdb.DuckDBDriver"),
}
# Options the library interprets; everything else is passed to the Spark reader.
OWN_OPTIONS = {
    "sep", "null_str", "records_key", "max_age_hours", "format", "window_seconds", "filter",
    "headers", "all_strings", "ignore_errors", "partition_column", "lower_bound", "upper_bound",
    "num_partitions", "schema",
}
CORRUPT = "_corrupt_record"


def csv_options(options: Mapping[str, Any]) -> dict[str, str]:
    """Spark CSV options for the source's ``sep``, ``null_str``, ``ignore_errors``."""
    out = {"header": "true", "sep": str(options.get("sep", ","))}
    if "null_str" in options:
        out["nullValue"] = str(options["null_str"])
    if options.get("ignore_errors"):
        out["mode"] = "DROPMALFORMED"
    if not options.get("all_strings") and "schema" not in options:
        out["inferSchema"] = "true"
    return out


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """The rows of a batch source."""
    options = dict(source.options)
    kind = source.type
    if kind in JDBC_DRIVERS:
        return spark.read.format("jdbc").options(**jdbc_options(source)).load()
    if kind == "dbt":
        return _read_model(spark, source)
    fmt = source.connection.get("format") if kind == "spark" else FILE_FORMATS.get(kind)
    fmt = options.get("format", fmt)
    if fmt is None:
        raise ValueError(f"source {source.name}: no batch reader for type {kind!r}")
    path = source.path or source.url
    if path is None:
        raise ValueError(f"source {source.name}: a path is required")
    reader = spark.read.format(fmt).options(
        **{k: str(v) for k, v in options.items() if k not in OWN_OPTIONS}
    )
    if fmt == "csv":
        reader = reader.options(**csv_options(options))
    if "schema" in options:
        reader = reader.schema(options["schema"])
    df = reader.load(s3a(path))
    if options.get("records_key"):
        df = records_under(df, options["records_key"])
    if options.get("filter"):
        df = equality_filter(df, options["filter"])
    return df


def s3a(path: str) -> str:
    return "s3a://" + path[len("s3://") :] if path.startswith("s3://") else path


def jdbc_options(source: Source) -> dict[str, str]:
    """Spark JDBC options; with a partition column the read is split over its range."""
    vendor, driver = JDBC_DRIVERS[source.type]
    c = source.connection
    url = source.url
    if url is None and source.type == "duckdb":
        url = f"jdbc:duckdb:{source.path}"
    if url is None:
        port = f":{c['port']}" if "port" in c else ""
        url = f"jdbc:{vendor}://{c['host']}{port}/{c['database']}"
    out = {"url": url, "driver": driver, "fetchsize": "10000"}
    if source.query:
        out["query"] = source.query
    else:
        out["dbtable"] = str(c["table"])
    for key in ("user", "password"):
        if key in c:
            out[key] = str(c[key])
    if "partition_column" in source.options:
        if source.query:
            # Spark splits a named table only, so the query becomes a derived table.
            out["dbtable"] = f"({out.pop('query')}) AS q"
        out["partitionColumn"] = str(source.options["partition_column"])
        out["lowerBound"] = str(source.options["lower_bound"])
        out["upperBound"] = str(source.options["upper_bound"])
        out["numPartitions"] = str(source.options["num_partitions"])
    return out


def _read_model(spark: SparkSession, source: Source) -> DataFrame:
    """The materialised table of a model: a catalog table, or its Parquet folder."""
    if source.path:
        return spark.read.parquet(s3a(source.path))
    c = source.connection
    schema = f"{c['target']}." if c.get("target") else ""
    return spark.table(f"{schema}{c['model']}")


def records_under(df: DataFrame, key: str) -> DataFrame:
    """One row per element of the array of objects stored under ``key``."""
    return df.select(F.explode(key).alias("_record")).select("_record.*")


def equality_filter(df: DataFrame, wanted: Mapping[str, Any]) -> DataFrame:
    """Rows whose columns equal every given value."""
    for column, value in wanted.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def split_bad_rows(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = False, **options: str
) -> tuple[DataFrame, DataFrame]:
    """Delimited lines as (good rows, raw text of the lines that do not fit the schema).

    Lines are parsed whole, so which columns are asked for later never changes which
    lines count as bad. A header line is recognised by the schema's column names.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path)
    if header:
        first = options.get("sep", ",").join(schema.names)
        lines = lines.filter(F.col("value") != first)
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields)
    parsed = lines.select(F.from_csv("value", ddl, settings).alias("r"))
    good = parsed.filter(F.col(f"r.{CORRUPT}").isNull()).select(*[f"r.{c}" for c in schema.names])
    return good, parsed.filter(F.col(f"r.{CORRUPT}").isNotNull()).select(f"r.{CORRUPT}")


def source_stats(df: DataFrame) -> DataFrame:
    """One row: row count, column count, files and bytes behind a file-based DataFrame."""
    files = df.groupBy("_metadata.file_path").agg(
        F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes")
    )
    return files.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.count("*").alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def source_schema(df: DataFrame) -> DataFrame:
    """Rows ``(position, column_name, column_type, nullable)``."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position bigint, column_name string, column_type string, nullable boolean"
    )


def source_page(df: DataFrame, key: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in key order."""
    return df.orderBy(*key).offset(offset).limit(limit)
