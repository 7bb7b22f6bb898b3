"""User functions with types taken from their annotations."""

from __future__ import annotations

import datetime
import decimal
import inspect
import typing
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SQL_TYPES = {
    str: "string", int: "bigint", float: "double", bool: "boolean", bytes: "binary",
    datetime.date: "date", datetime.datetime: "timestamp", decimal.Decimal: "decimal(38,18)",
}


@dataclass(frozen=True)
class FunctionParam:
    name: str
    type: str
    required: bool
    default: Any = None


def sql_type(annotation: Any) -> str:
    """Spark type of a Python annotation; ``list[T]`` and ``T | None`` included."""
    if annotation in SQL_TYPES:
        return SQL_TYPES[annotation]
    inner = [a for a in typing.get_args(annotation) if a is not type(None)]
    if typing.get_origin(annotation) is list and inner:
        return f"array<{sql_type(inner[0])}>"
    if len(inner) == 1:
        return sql_type(inner[0])
    raise TypeError(f"no SQL type for {annotation!r}")


def parameters(fn: Callable) -> list[FunctionParam]:
    """The parameters of a function; those without annotation are strings."""
    hints = typing.get_type_hints(fn)
    found = []
    for name, p in inspect.signature(fn).parameters.items():
        missing = p.default is inspect.Parameter.empty
        kind = sql_type(hints.get(name, str))
        found.append(FunctionParam(name, kind, missing, None if missing else p.default))
    return found


def register_function(spark: SparkSession, fn: Callable, name: str | None = None):
    """Make an annotated Python function callable from SQL and from DataFrames.

    Rows travel in Arrow batches. Prefer built-in expressions where one exists.
    """
    parameters(fn)
    returns = sql_type(typing.get_type_hints(fn).get("return", str))
    wrapped = F.udf(fn, returns, useArrow=True)
    return spark.udf.register(name or fn.__name__, wrapped)
