"""Zero-filled day series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(df: DataFrame, ts: str, last_day: str, days: int) -> DataFrame:
    """``day, n`` for each of the last ``days`` days, with zero where nothing happened."""
    last = F.lit(last_day).cast("date")
    first = F.date_sub(last, days - 1)
    counts = (
        df.filter(F.to_date(ts).between(first, last))
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("n"))
    )
    calendar = df.sparkSession.range(1).select(
        F.explode(F.sequence(first, last)).alias("day")
    )
    return calendar.join(counts, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n")
    )
