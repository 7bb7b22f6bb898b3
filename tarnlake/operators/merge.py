"""Slowly changing dimensions as rewrites of plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnlake.functions.ordered import HOT_ROWS, first_per_key, null_safe_join, sliced, split_hot

FROM, TO, CURRENT = "effective_from", "effective_to", "is_current"


def latest_changes(changes: DataFrame, pk: Sequence[str], ts: str) -> DataFrame:
    """The newest change of each key; equal times are settled by the other columns."""
    others = [c for c in changes.columns if c not in (*pk, ts)]
    order = [F.desc_nulls_last(ts), *[F.asc_nulls_last(c) for c in others]]
    return first_per_key(changes, pk, order)


def scd1_merge(target: DataFrame, changes: DataFrame, pk: Sequence[str], ts: str) -> DataFrame:
    """Target with every changed key replaced by its newest change and new keys added.

    When the target carries ``ts`` itself, a change older than the held row is ignored,
    so late or repeated batches do no harm.
    """
    newest = latest_changes(changes, pk, ts)
    if ts in target.columns:
        held = target.select(*pk, F.col(ts).alias("_held"))
        newest = (
            newest.join(held, list(pk), "left")
            .filter(F.col("_held").isNull() | (F.col(ts) >= F.col("_held")))
            .drop("_held")
        )
    kept = target.join(newest.select(*pk), list(pk), "left_anti")
    return kept.unionByName(newest.select(*target.columns))


def scd2_history(
    changes: DataFrame,
    pk: Sequence[str],
    ts: str,
    tracked: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Version rows of a change log: pk, tracked columns, effective_from/to, is_current.

    A change that leaves the tracked columns as they were makes no version. The version
    ends where the next one starts. Keys are primary keys, so never null. Keys with very
    many changes (``hot_rows``) are cut into ranges of ``ts`` (any type that orders), so many tasks share them.
    """
    pk = list(pk)

    def moments(rows: DataFrame) -> DataFrame:
        # Several rows of one key at one time: the greatest state stands for the moment.
        state = F.max(F.struct(*tracked)).alias("_state")
        return rows.groupBy(*pk, F.col(ts).alias("_at")).agg(state)

    cold, hot = split_hot(changes, pk, hot_rows)
    versions = _versions(moments(cold), pk)
    if hot is not None:
        versions = versions.unionByName(_versions_in_slices(moments(hot), pk))
    return versions.select(
        *pk,
        *[F.col("_state")[c].alias(c) for c in tracked],
        F.col("_at").alias(FROM),
        F.col("_ends").alias(TO),
        F.col("_ends").isNull().alias(CURRENT),
    )


def _versions(log: DataFrame, pk: list[str]) -> DataFrame:
    """``pk, _at, _state, _ends`` of the rows that start a version."""
    w = W.partitionBy(*pk).orderBy("_at")
    before = F.col("_before")
    starts = log.withColumn("_before", F.lag("_state").over(w)).filter(
        before.isNull() | ~before.eqNullSafe(F.col("_state"))
    )
    return starts.select(*pk, "_at", "_state", F.lead("_at").over(w).alias("_ends"))


def _versions_in_slices(log: DataFrame, pk: list[str]) -> DataFrame:
    """The same for hot keys: rows are ordered inside ``(pk, slice)`` only."""
    cell = [*pk, "_slice"]
    log = sliced(log, [*pk, "_at"])
    inside = W.partitionBy(*cell).orderBy("_at")
    log = log.withColumn("_before", F.lag("_state").over(inside))
    differs = F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(F.col("_state"))

    # One row per (key, slice) links the slices: the state each one starts from, and
    # when the next version after it begins.
    edges = log.groupBy(*cell).agg(
        F.min("_at").alias("_first_at"),
        F.min_by("_state", "_at").alias("_first_state"),
        F.max_by("_state", "_at").alias("_last_state"),
        F.min(F.when(differs, F.col("_at"))).alias("_first_inner"),
    )
    along = W.partitionBy(*pk).orderBy("_slice")
    edges = edges.withColumn("_carried", F.lag("_last_state").over(along))
    opens = F.col("_carried").isNull() | ~F.col("_carried").eqNullSafe(F.col("_first_state"))
    edges = edges.withColumn(
        "_starts", F.when(opens, F.col("_first_at")).otherwise(F.col("_first_inner"))
    )
    later = along.rowsBetween(1, W.unboundedFollowing)
    edges = edges.select(*cell, "_carried", F.min("_starts").over(later).alias("_next_slice"))

    before = F.coalesce("_before", "_carried")
    starts = log.join(edges, cell).filter(before.isNull() | ~before.eqNullSafe(F.col("_state")))
    ends = F.coalesce(F.lead("_at").over(inside), F.col("_next_slice"))
    return starts.select(*pk, "_at", "_state", ends.alias("_ends"))


def scd2_merge(
    target: DataFrame,
    changes: DataFrame,
    pk: Sequence[str],
    ts: str,
    tracked: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """(new target, rejected changes) after applying a batch to a version table.

    Closed versions and keys without changes pass through untouched. Changes not newer
    than the key's open version, and changes without a time, are rejected. Several changes of a key become
    consecutive versions.
    """
    pk, tracked = list(pk), list(tracked)
    batch = changes.select(*pk, *tracked, ts)
    opened = target.filter(F.col(CURRENT))
    starts = opened.select(*pk, F.col(FROM).alias("_open_from"))
    placed = null_safe_join(batch, starts, pk, "left")
    late = F.col(ts).isNull() | F.coalesce(F.col(ts) <= F.col("_open_from"), F.lit(False))
    rejected = placed.filter(late).drop("_open_from")
    accepted = placed.filter(~late).drop("_open_from")
    keys = accepted.select(*pk).distinct()
    touched = opened.join(keys, pk, "left_semi")
    untouched = opened.join(keys, pk, "left_anti")
    timeline = touched.select(*pk, *tracked, F.col(FROM).alias(ts)).unionByName(accepted)
    merged = scd2_history(timeline, pk, ts, tracked)
    columns = target.columns
    return (
        target.filter(~F.col(CURRENT))
        .unionByName(untouched)
        .unionByName(merged.select(*columns)),
        rejected,
    )
