"""Feature preparation and bookkeeping."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prepare_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the given columns as doubles: absent ones and nulls become 0."""
    ready = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
        if c in df.columns
        else F.lit(0.0).alias(c)
        for c in columns
    ]
    return df.select(*keep, *ready)


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows picked by a seeded hash of the key: the same rows on every run."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def missing_features(required: DataFrame, available: DataFrame) -> DataFrame:
    """Per model ``model, required, missing, status``.

    ``required`` has ``model, feature``; ``available`` has ``feature``.
    """
    have = available.select("feature").distinct().withColumn("_have", F.lit(1))
    return (
        required.distinct()
        .join(have, "feature", "left")
        .groupBy("model")
        .agg(F.count("*").alias("required"), F.count_if(F.col("_have").isNull()).alias("missing"))
        .withColumn("status", F.when(F.col("missing") == 0, "ok").otherwise("warn"))
    )


def feature_inventory(groups: Mapping[str, DataFrame]) -> DataFrame:
    """Per feature group ``group_name, columns, row_count``."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("group_name"),
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
            "row_count",
        )
        for name, df in groups.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)
