"""Schema contracts: snapshot, diff, accept, enforce."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRACT_SCHEMA = "table_name string, column_name string, column_type string"


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """Contract rows of a table: ``table_name, column_name, column_type``."""
    rows = [(name, column, kind) for column, kind in df.dtypes]
    return df.sparkSession.createDataFrame(rows, CONTRACT_SCHEMA)


def diff(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """Drift events ``table_name, kind, column_name, old_type, new_type``.

    A table with no contract has nothing to drift from and yields no events.
    """
    old = contract.withColumnRenamed("column_type", "old_type")
    known = contract.select("table_name").distinct()
    new = observed.withColumnRenamed("column_type", "new_type").join(
        known, "table_name", "left_semi"
    )
    kind = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .otherwise("type_changed")
    )
    return (
        old.join(new, ["table_name", "column_name"], "full")
        .filter(~F.col("old_type").eqNullSafe(F.col("new_type")))
        .select("table_name", kind.alias("kind"), "column_name", "old_type", "new_type")
    )


def accept(
    events: DataFrame, contract: DataFrame, observed: DataFrame, accepted: Column
) -> tuple[DataFrame, DataFrame]:
    """(events with accepted ones marked, contract with their tables taken as observed)."""
    marked = events.withColumn("accepted", F.col("accepted") | accepted)
    promoted = events.filter(accepted).select("table_name").distinct()
    kept = contract.join(promoted, "table_name", "left_anti")
    taken = observed.join(promoted, "table_name", "left_semi")
    return marked, kept.unionByName(taken)


def history(events: DataFrame, limit: int = 200) -> DataFrame:
    """Drift events, newest first."""
    return events.orderBy(F.desc_nulls_last("detected_at"), "table_name", "column_name").limit(limit)


class SchemaViolation(RuntimeError):
    """The table lacks contract columns, or holds them in a type that does not widen."""


# Types whose values all fit the wider one.
WIDENS = {
    ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"),
    ("smallint", "bigint"), ("int", "bigint"), ("int", "double"), ("float", "double"),
}


def enforce(df: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    """Exactly the contract's columns in its order and types.

    Extra columns are dropped and narrower numbers widened; a missing column or another
    type raises before anything is written.
    """
    have = dict(df.dtypes)
    missing = [c for c in contract if c not in have]
    changed = [
        c
        for c, kind in contract.items()
        if c in have and have[c] != kind and (have[c], kind) not in WIDENS
    ]
    if missing or changed:
        raise SchemaViolation(f"removed: {missing}; type changed: {changed}")
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in contract.items()])
