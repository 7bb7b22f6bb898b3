"""Slowly changing dimensions on bucketed tables: a batch rewrites only the buckets its keys fall into."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.merge import CURRENT, FROM, TO, latest_changes, scd1_merge, scd2_merge
from tarnlake.sources.manifest import Entry, Part
from tarnlake.sources.tables import BUCKET_ROWS, Batch, bucket_of

OPEN, CLOSED = "open", "closed"


def _touched(batch: Batch, held: Entry, changes: DataFrame) -> tuple[list[Part], list[Part]]:
    """(parts of the buckets that the changes fall into, all other parts)."""
    # At most one number per bucket comes to the driver.
    hit = {r[0] for r in changes.select(bucket_of(held.key, held.buckets)).distinct().collect()}
    inside = [p for p in held.parts if p.bucket in hit]
    return inside, [p for p in held.parts if p.bucket not in hit]


def _typed(changes: DataFrame, like: DataFrame, columns: Sequence[str]) -> DataFrame:
    return changes.withColumns({c: F.col(c).cast(like.schema[c].dataType) for c in columns if c in like.columns})


def _buckets(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


def put_keyed(batch: Batch, table: str, df: DataFrame, pk: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> None:
    """Make ``df`` the table, in buckets of its key."""
    n = _buckets(df.count(), bucket_rows)
    batch.put(table, batch.stage_buckets(df, table, bucket_of(pk, n)), buckets=n, key=tuple(pk))


def merge_scd1(batch: Batch, table: str, changes: DataFrame, pk: Sequence[str], ts: str, bucket_rows: int = BUCKET_ROWS) -> int:
    """Replace every changed key's row by its newest change and add new keys; returns the rows rewritten.

    The table must be keyed by ``pk`` (``put_keyed``) or not exist yet. It is read and written in the
    buckets that hold changed keys only; the files of all others stay as they are. A change older than
    the held row is ignored where the table carries ``ts``.
    """
    held = batch.entry(table)
    if held is None or not held.parts:
        newest = latest_changes(changes, pk, ts)
        put_keyed(batch, table, newest, pk, bucket_rows=bucket_rows)
        return batch.entry(table).rows
    if held.key != tuple(pk):
        raise ValueError(f"{table} is not keyed by {list(pk)}")
    changes = _typed(changes, batch.read_part(held.parts[0]), pk)
    inside, others = _touched(batch, held, changes)
    like = batch.read_part(held.parts[0])
    target = batch.read_part(*inside) if inside else like.limit(0)
    merged = scd1_merge(target, changes, list(pk), ts)
    parts = batch.stage_buckets(merged, table, bucket_of(pk, held.buckets))
    batch.put(table, [*others, *parts])
    return sum(p.rows for p in parts)


def merge_scd2(
    batch: Batch, table: str, changes: DataFrame, pk: Sequence[str], ts: str, tracked: Sequence[str], bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Apply changes to a version table; returns the rejected ones (late or without a time).

    Open versions lie in buckets of the key, and only those of changed keys are read and rewritten.
    Closed versions are added as a part of their own and never touched again.
    """
    pk, tracked = list(pk), list(tracked)
    held = batch.entry(table) or Entry()
    opened = [p for p in held.parts if p.kind == OPEN]
    kinds = ", ".join(f"`{c}` {changes.schema[c].dataType.simpleString()}" for c in (*pk, *tracked))
    time = changes.schema[ts].dataType.simpleString()
    nothing = batch.spark.createDataFrame([], f"{kinds}, {FROM} {time}, {TO} {time}, {CURRENT} boolean")
    if held.parts:
        if held.key != tuple(pk):
            raise ValueError(f"{table} is not keyed by {pk}")
        nothing = batch.read_part(held.parts[0]).limit(0)
        changes = _typed(changes, nothing, [*pk, *tracked])
    n = held.buckets or _buckets(changes.count(), bucket_rows)
    inside: list[Part] = []
    if opened:
        inside, _ = _touched(batch, held, changes)
        inside = [p for p in inside if p.kind == OPEN]
    target = batch.read_part(*inside) if inside else nothing
    merged, rejected = scd2_merge(target, changes, pk, ts, tracked)
    # One write: open versions by bucket, closed ones together.
    parts = batch.stage_buckets(merged, table, F.when(F.col(CURRENT), bucket_of(pk, n)).otherwise(F.lit(-1)))
    parts = [replace(p, bucket=None, kind=CLOSED) if p.bucket == -1 else replace(p, kind=OPEN) for p in parts]
    # What was closed before is not read, so it is not among the merged rows either.
    kept = [p for p in held.parts if p not in inside]
    batch.put(table, [*kept, *parts], buckets=n, key=tuple(pk))
    return rejected
