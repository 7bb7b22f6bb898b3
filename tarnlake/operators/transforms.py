"""The declarative steps of a pipeline, and a preview of their row counts."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tarnlake.functions.ordered import first_per_key

STEP_TYPES = ("filter", "derive", "deduplicate", "fill_null", "sql")


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    return df.filter(F.expr(condition))


def derive(df: DataFrame, name: str, expression: str) -> DataFrame:
    return df.withColumn(name, F.expr(expression))


def deduplicate(
    df: DataFrame, key: str | Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the first in ``order``, else in the order of all other columns."""
    keys = [k.strip() for k in key.split(",")] if isinstance(key, str) else list(key)
    given = list(order or [])
    rest = [c for c in df.columns if c not in keys and c not in given]
    return first_per_key(df, keys, [F.asc_nulls_last(c) for c in given + rest])


def fill_null(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Replace nulls by the default, cast to the column's type."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in defaults.items()}
    )


def sql_step(df: DataFrame, sql: str) -> DataFrame:
    """A SELECT over ``_data`` (the step's input) and any registered view."""
    view = f"_data_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(view)
    # A private view name keeps concurrent pipelines apart; the query still says _data.
    return df.sparkSession.sql(f"WITH _data AS (SELECT * FROM {view}) {_as_relation(sql)}")


def _as_relation(sql: str) -> str:
    text = sql.strip().rstrip(";")
    return f"SELECT * FROM (\n{text}\n)"


def apply_step(df: DataFrame, step: Mapping[str, Any]) -> DataFrame:
    kind = step["type"]
    if kind == "filter":
        return filter_rows(df, step["condition"])
    if kind == "derive":
        return derive(df, step["name"], step["expression"])
    if kind == "deduplicate":
        return deduplicate(df, step["key"], step.get("order"))
    if kind == "fill_null":
        return fill_null(df, step["defaults"])
    if kind == "sql":
        return sql_step(df, step["sql"])
    raise ValueError(f"unknown step type {kind!r}; expected one of {STEP_TYPES}")


def apply_steps(df: DataFrame, steps: Sequence[Mapping[str, Any]]) -> DataFrame:
    return functools.reduce(apply_step, steps, df)


def with_step(steps: Sequence, step: Mapping[str, Any], at: int | None = None) -> list:
    out = list(steps)
    out.insert(len(out) if at is None else at, step)
    return out


def without_step(steps: Sequence, index: int) -> list:
    return [s for i, s in enumerate(steps) if i != index]


def moved_step(steps: Sequence, index: int, to: int) -> list:
    out = list(steps)
    out.insert(to, out.pop(index))
    return out


def stage_counts(df: DataFrame, steps: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Rows after the source and after each step, from one run of the whole chain.

    An observation counts the rows that pass each point, so no stage is computed twice.
    """
    spark = df.sparkSession
    names = ["source", *[s["type"] for s in steps]]
    watched = []

    def watch(frame: DataFrame) -> DataFrame:
        seen = Observation(f"rows_{uuid.uuid4().hex[:8]}")
        watched.append(seen)
        return frame.observe(seen, F.count(F.lit(1)).alias("n"))

    out = watch(df)
    for step in steps:
        out = watch(apply_step(out, step))
    out.write.format("noop").mode("overwrite").save()
    rows = [(i, name, seen.get["n"]) for i, (name, seen) in enumerate(zip(names, watched))]
    return spark.createDataFrame(rows, "stage bigint, step string, row_count bigint")
