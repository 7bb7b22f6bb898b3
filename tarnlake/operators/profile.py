"""Table listing, profiles and read-only SQL."""

from __future__ import annotations

import datetime
import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.ordered import top_per_key
from tarnlake.sources.readers import source_stats
from tarnlake.sources.tables import Lakehouse


def list_tables(lake: Lakehouse) -> DataFrame:
    """Per table ``layer, table_name, row_count, column_count, files, bytes``."""
    parts = [
        source_stats(lake.read(name, layer)).select(
            F.lit(layer).alias("layer"), F.lit(name).alias("table_name"), "*"
        )
        for layer, name in lake.tables()
    ]
    if not parts:
        return lake.spark.createDataFrame(
            [],
            "layer string, table_name string, row_count bigint, column_count bigint, "
            "files bigint, bytes bigint",
        )
    return functools.reduce(DataFrame.unionByName, parts)


def null_profile(df: DataFrame) -> DataFrame:
    """Per column ``column_name, row_count, nulls, null_rate, min, max, mean``, in one scan.

    Minimum and maximum are text; the mean is given for numbers only.
    """
    cells, aggregates = [], [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(df.schema.fields):
        numeric = isinstance(f.dataType, T.NumericType)
        ordered = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        low = F.min(f.name).cast("string") if ordered else F.lit(None).cast("string")
        high = F.max(f.name).cast("string") if ordered else F.lit(None).cast("string")
        mean = F.avg(f.name) if numeric else F.lit(None).cast("double")
        aggregates += [
            F.count_if(F.col(f.name).isNull()).alias(f"z{i}"), low.alias(f"l{i}"),
            high.alias(f"h{i}"), mean.alias(f"m{i}"),
        ]
        cells.append(
            F.struct(
                F.lit(f.name).alias("column_name"), F.col("_n").alias("row_count"),
                F.col(f"z{i}").alias("nulls"),
                F.round(F.try_divide(F.col(f"z{i}"), F.col("_n")), 6).alias("null_rate"),
                F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"),
                F.col(f"m{i}").alias("mean"),
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` commonest values of each column with count and rank.

    The table is unpivoted once; values are counted before anything is ordered.
    """
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
             for c in columns]
    counts = (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.*")
        .filter("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
    )
    return top_per_key(counts, ["column_name"], [F.desc("n"), F.asc("value")], k)


def preview(df: DataFrame, rows: int = 8, order: Sequence[str] = ()) -> DataFrame:
    """A few rows; the first ones in key order when an order is given."""
    return (df.orderBy(*order) if order else df).limit(rows)


READ_ONLY = ("select", "with", "values", "show", "describe", "explain", "from")


def console(lake: Lakehouse, statement: str) -> DataFrame:
    """One read-only statement over all tables, under ``name`` and ``layer_name``."""
    lake.register_views()
    return read_only_sql(lake.spark, statement)


def _refuse_writes(spark: SparkSession, text: str) -> None:
    """Refuse a query whose parsed plan holds an insert or a command anywhere."""
    open_ = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while open_:
        node = open_.pop()
        name = node.getClass().getSimpleName()
        if name.startswith("InsertInto") or is_instance_of(
            spark.sparkContext._gateway, node, "org.apache.spark.sql.catalyst.plans.logical.Command"
        ):
            raise PermissionError(f"{name} is not read-only")
        for nodes in (node.children(), node.innerChildren()):
            held = nodes.iterator()
            while held.hasNext():
                child = held.next()
                if is_instance_of(
                    spark.sparkContext._gateway, child, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
                ):
                    open_.append(child)


def read_only_sql(spark: SparkSession, statement: str, **args: Any) -> DataFrame:
    text = statement.strip().rstrip(";")
    words = text.split(None, 1)
    if not words or words[0].lower().lstrip("(") not in READ_ONLY:
        raise PermissionError("only SELECT, WITH, VALUES, SHOW, DESCRIBE and EXPLAIN are allowed")
    # Spark parses exactly one statement, so a second one after ';' is a syntax error.
    if words[0].lower().lstrip("(") in ("select", "with", "values", "from"):
        _refuse_writes(spark, text)
    return spark.sql(text, args=args) if args else spark.sql(text)


def _boolean(value: Any) -> bool:
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes")


# Parameter types of a template, with the conversion of a given value.
PARAM_TYPES = {"string": str, "int": int, "double": float, "boolean": _boolean,
               "timestamp": datetime.datetime.fromisoformat}


@dataclass(frozen=True)
class Param:
    name: str
    type: str = "string"
    required: bool = False
    default: Any = None


@dataclass(frozen=True)
class SqlTemplate:
    """SQL text with ``:name`` markers bound as values, never spliced into the text."""

    sql: str
    params: Sequence[Param] = ()

    def call(self, spark: SparkSession, values: Mapping[str, Any] | None = None) -> DataFrame:
        values = dict(values or {})
        unknown = set(values) - {p.name for p in self.params}
        if unknown:
            raise TypeError(f"unknown parameters {sorted(unknown)}")
        bound = {}
        for p in self.params:
            if p.name not in values and p.required:
                raise TypeError(f"missing parameter {p.name!r}")
            value = values.get(p.name, p.default)
            bound[p.name] = None if value is None else PARAM_TYPES[p.type](value)
        return read_only_sql(spark, self.sql, **bound)
