"""Distribution drift (PSI) and z-score anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.ordered import exact_quantile

EPSILON = 1e-6
THRESHOLD = 0.15
MIN_ROWS = 10


def severity(psi: Column) -> Column:
    return F.when(psi < 0.1, "ok").when(psi < 0.3, "warn").otherwise("critical")


def half_flag(df: DataFrame, order: str) -> DataFrame:
    """Adds ``is_reference``: rows up to the median of the order column."""
    middle = exact_quantile(df, order, 0.5)
    return df.withColumn("is_reference", F.col(order) <= F.lit(middle))


def numeric_features(df: DataFrame, leave_out: Sequence[str] = ()) -> list[str]:
    kinds = ("double", "float", "bigint", "int")
    return [c for c, t in df.dtypes if t in kinds and c not in leave_out]


def psi(
    df: DataFrame,
    features: Sequence[str],
    is_reference: str = "is_reference",
    bins: int = 10,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per feature ``feature, n_reference, n_current, psi, drift_detected, severity``.

    Bins have equal width over the reference range; values outside fall into the end
    bins. All features share two scans: one for the ranges, one for the bin counts.
    """
    side = F.col(is_reference)
    ranges = df.agg(
        F.struct(
            *[F.min(F.when(side, F.col(f))).cast("double").alias(f"lo{i}")
              for i, f in enumerate(features)],
            *[F.max(F.when(side, F.col(f))).cast("double").alias(f"hi{i}")
              for i, f in enumerate(features)],
        ).alias("r")
    )
    ranged = df.select(*features, side.alias("_ref")).withColumn("_r", ranges.scalar())

    def bin_of(i: int, f: str) -> Column:
        low, high = F.col("_r")[f"lo{i}"], F.col("_r")[f"hi{i}"]
        width = (high - low) / bins
        place = F.floor(F.try_divide(F.col(f) - low, width))
        # A constant reference has no width: everything is in one bin.
        return F.when(F.col(f).isNotNull(), F.coalesce(F.least(F.greatest(place, F.lit(0)),
                                                               F.lit(bins - 1)), F.lit(0)))

    cells = [F.struct(F.lit(f).alias("feature"), bin_of(i, f).alias("bin"))
             for i, f in enumerate(features)]
    counts = (
        ranged.select("_ref", F.explode(F.array(*cells)).alias("c"))
        .filter("c.bin IS NOT NULL")
        .groupBy("c.feature", "c.bin")
        .agg(F.count_if("_ref").alias("r"), F.count_if(~F.col("_ref")).alias("c"))
    )
    totals = counts.groupBy("feature").agg(
        F.sum("r").alias("n_reference"), F.sum("c").alias("n_current")
    )
    ref = F.col("r") / F.col("n_reference") + EPSILON
    cur = F.col("c") / F.col("n_current") + EPSILON
    score = F.sum((cur - ref) * F.ln(cur / ref))
    return (
        counts.join(totals, "feature")
        .filter("n_reference > 0 AND n_current > 0")
        .groupBy("feature", "n_reference", "n_current")
        .agg(score.alias("psi"))
        .withColumn("drift_detected", F.col("psi") > threshold)
        .withColumn("severity", severity(F.col("psi")))
        .withColumn("psi", F.round("psi", 4))
    )


def zscore_anomalies(
    df: DataFrame, column: str, key: Sequence[str], threshold: float = 3.0, limit: int = 50
) -> DataFrame:
    """The strongest outliers: key, value and ``z_score``; nothing when the spread is 0."""
    stats = df.agg(F.struct(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))).scalar()
    # A zero spread divides to null, and null passes no filter.
    z = F.try_divide(F.col(column) - F.col("_s")["mean"], F.nullif(F.col("_s")["sd"], F.lit(0.0)))
    return (
        df.select(*key, column)
        .withColumn("_s", stats)
        .withColumn("_z", z)
        .filter(F.abs("_z") > threshold)
        .orderBy(F.desc(F.abs("_z")), *key)
        .limit(limit)
        .select(*key, column, F.round("_z", 2).alias("z_score"))
    )
