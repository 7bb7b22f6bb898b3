"""Watermarks, content-hash state and backfill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.hashing import row_hash
from tarnlake.functions.ordered import first_per_key

EPOCH = "2000-01-01 00:00:00"


def batch_watermarks(batch: DataFrame, source: str | Column, ts: str) -> DataFrame:
    """``(source, watermark)`` reached by a batch."""
    key = F.lit(source) if isinstance(source, str) else source
    return batch.groupBy(key.alias("source")).agg(F.max(ts).alias("watermark"))


def advance_watermarks(state: DataFrame, reached: DataFrame) -> DataFrame:
    """State after a batch: per source the later of the two marks, never moving back."""
    return (
        state.select("source", "watermark")
        .unionByName(reached.select("source", "watermark"))
        .groupBy("source")
        .agg(F.max("watermark").alias("watermark"))
    )


def after_watermark(df: DataFrame, ts: str, mark, lateness: str | None = None) -> DataFrame:
    """Rows later than the mark; ``lateness`` (an interval) rereads that much before it.

    Rows without a time are always read; the content hashes tell which are new. ``mark`` is a time or its text; None keeps every row. The filter compares the column
    with a constant of its own type, so it reaches the scan.
    """
    if mark is None:
        return df
    limit = F.lit(mark).cast(df.schema[ts].dataType)
    if lateness:
        limit = limit - F.expr(f"INTERVAL {lateness}")
    return df.filter((F.col(ts) > limit) | F.col(ts).isNull())


def drop_seen(
    batch: DataFrame,
    seen: DataFrame,
    columns: Sequence[str] | None = None,
    order: Sequence[Column] = (),
) -> DataFrame:
    """Rows of the batch whose content hash is new, once each, with the hash attached.

    ``seen`` has a ``content_hash`` column. Copies collapse before the anti join, so a
    content repeated many times shuffles once per input partition.
    """
    hashed = batch.withColumn("content_hash", row_hash(batch, columns))
    if order:
        once = first_per_key(hashed, ["content_hash"], order)
    else:
        once = hashed.dropDuplicates(["content_hash"])
    return once.join(seen.select("content_hash"), "content_hash", "left_anti")


def hash_counts(watermarks: DataFrame, hashes: DataFrame) -> DataFrame:
    """Every watermark with the number of content hashes held for its source."""
    held = hashes.groupBy("source").agg(F.count("*").alias("hash_count"))
    return watermarks.join(held, "source", "left").withColumn(
        "hash_count", F.coalesce("hash_count", F.lit(0))
    )


def reset_source(
    watermarks: DataFrame, hashes: DataFrame, source: str, clear_hashes: bool = True
) -> tuple[DataFrame, DataFrame]:
    """State for a backfill of one source.

    Clearing forgets the mark and the hashes. Keeping the hashes only moves the mark to
    the epoch, so a rerun rereads everything and takes in what was never seen.
    """
    others = watermarks.filter(F.col("source") != source)
    if clear_hashes:
        return others, hashes.filter(F.col("source") != source)
    kind = watermarks.schema["watermark"].dataType
    moved = watermarks.filter(F.col("source") == source).withColumn(
        "watermark", F.lit(EPOCH).cast(kind)
    )
    return others.unionByName(moved), hashes
