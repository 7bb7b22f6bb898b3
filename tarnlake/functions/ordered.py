"""Order-dependent operators that stay parallel when one group is very large.

``rank``, ``lead``/``lag`` and exact quantiles over a plain window put each group
in one task. Here a group is cut into ranges of the value first; only totals per range
are ordered across ranges, so the sort work of a hot group is spread out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.session import reliable_checkpoint

DEFAULT_BUCKETS = 64
# Rows that a quantile orders in the end, and rows of one key that one task orders comfortably.
LAST_ROWS = 100_000
HOT_ROWS = 1_000_000
BROADCAST_ROWS = 1_000_000


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key under a total order.

    The ``row_number() <= 1`` filter lets Spark keep one row per key on the map side
    (WindowGroupLimit), so a hot key shuffles at most one row per input partition.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each key with their 1-based position in ``rank``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).filter(F.col(rank) <= k)


def sliced(df: DataFrame, order: Sequence[str | Column], out: str = "_slice") -> DataFrame:
    """``df`` cut into ranges of ``order``, a task each, with the number of the range in ``out``.

    Any type that orders will do. The rows are checkpointed, for the borders are sampled and must not
    move between two readings. Rows equal in ``order`` stay in one range, so end it with something that
    tells them apart or count equal rows first.
    """
    return reliable_checkpoint(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()))


def counts_before(
    df: DataFrame, keys: Sequence[str], value: str, descending: bool = False
) -> DataFrame:
    """Distinct ``(keys, value)`` with ``n`` rows and ``n_before`` rows ordered ahead of them.

    Equal values are counted before anything is ordered, so ties never pile up in a task.
    The values are range-sorted over all keys: each task sums its own range, and one row per
    key and range carries the total of the ranges before it. Any type that orders works, at
    every size; NaN is the greatest number. Null values are left out.
    """
    keys = list(keys)
    values = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = F.desc(value) if descending else F.asc(value)
    values = sliced(values, [*keys, order])
    running = F.sum("n").over(W.partitionBy(*keys, "_slice").orderBy(order)) - F.col("n")
    totals = values.groupBy(*keys, "_slice").agg(F.sum("n").alias("_total"))
    # Without keys one constant group holds a row per range.
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ahead = F.sum("_total").over(whole.orderBy("_slice")) - F.col("_total")
    offsets = totals.select(*keys, "_slice", ahead.alias("_offset"))
    running = values.withColumn("_inside", running)
    return null_safe_join(running, offsets, [*keys, "_slice"], "inner").select(
        *keys, value, "n", (F.col("_inside") + F.col("_offset")).alias("n_before")
    )


def row_numbers(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """``df`` with the place of each row, from 0, in a total order over everything.

    ``order`` must tell all rows apart, or rows equal in it come in any order.
    """
    rows = sliced(df, order)
    inside = F.row_number().over(W.partitionBy("_slice").orderBy(*order)) - 1
    totals = rows.groupBy("_slice").agg(F.count("*").alias("_total"))
    before = F.sum("_total").over(W.orderBy("_slice")) - F.col("_total")
    offsets = totals.select("_slice", before.alias("_offset"))
    numbered = rows.withColumn("_inside", inside).join(offsets, "_slice")
    return numbered.withColumn(out, F.col("_inside") + F.col("_offset")).select(*df.columns, out)


def split_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys with more than ``hot_rows`` rows or None).

    One partial aggregate over the key columns finds the hot keys. There are at most
    ``rows / hot_rows`` of them; their number is checked before they are broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    hot = reliable_checkpoint(counts.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    found = hot.count()
    if not found:
        return df, None
    side = F.broadcast(hot) if found <= BROADCAST_ROWS else hot
    same = functools.reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    )
    return df.join(side, same, "left_anti"), df.join(side, same, "left_semi")


def rank_split(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    descending: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``RANK()`` per key, or over everything with no keys; null values have no rank.

    Ordinary keys take one window. Hot keys, and the global rank, are ranked through
    counts per distinct value, so no task orders a whole hot group.
    """
    cold, hot = split_hot(df, keys, hot_rows) if keys else (None, df)
    parts = []
    if cold is not None:
        order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
        rank = F.rank().over(W.partitionBy(*keys).orderBy(order)).cast("bigint")
        parts.append(cold.withColumn(out, F.when(F.col(value).isNotNull(), rank)))
    if hot is not None:
        places = counts_before(hot, keys, value, descending)
        places = places.select(*keys, value, (F.col("n_before") + 1).alias(out))
        parts.append(null_safe_join(hot, places, [*keys, value], "left"))
    return functools.reduce(DataFrame.unionByName, parts)


def _cuts(part: DataFrame, value: str, n: int) -> list:
    """At most ``n`` distinct values of a sample of rows, in order. Each task hands on at most that many."""
    picked = part.withColumn("_at", F.rand(7)).orderBy("_at").limit(4 * n).select(value).distinct()
    found = [r[0] for r in picked.orderBy(value).collect()]
    return found[:: max(1, -(-len(found) // n))]


def _place(value: Column, cuts: Sequence, first: int = 0) -> Column:
    """The place of a value among the cuts, as a balanced tree of comparisons with typed constants.

    Cut ``i`` itself is place ``2 * i + 1``; the gap below it is ``2 * i``.
    """
    if not cuts:
        return F.lit(2 * first)
    middle = len(cuts) // 2
    at = F.lit(cuts[middle])
    return (
        F.when(value == at, 2 * (first + middle) + 1)
        .when(value < at, _place(value, cuts[:middle], first))
        .otherwise(_place(value, cuts[middle + 1 :], first + middle + 1))
    )


def exact_quantile(
    df: DataFrame, value: str, q: float, buckets: int = DEFAULT_BUCKETS, small: int = LAST_ROWS
):
    """The smallest value whose cumulative share reaches ``q``; None without values.

    Each round counts rows per bucket (a partial aggregate, no shuffle of rows) and goes
    on with the one bucket that holds the answer, so the column is read a few times and
    never sorted. Only the last, small part is ordered. Any type that orders will do; NaN is
    the greatest number.
    """
    kind = df.schema[value].dataType
    timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
    # Times travel to the driver and back as microseconds, which no zone shifts.
    plain = F.unix_micros(F.col(value).cast("timestamp")) if timed else F.col(value)
    part = df.select(plain.alias("v")).filter("v IS NOT NULL")
    size = part.count()
    if not size:
        return None
    place = max(math.ceil(size * q), 1)
    found = None
    while found is None and size > small:
        cuts = _cuts(part, "v", buckets)
        counted = part.groupBy(_place(F.col("v"), cuts).alias("p")).count()
        # At most two rows per bucket.
        for row in sorted(counted.collect()):
            if place <= row["count"]:
                break
            place -= row["count"]
        index, is_cut = divmod(row["p"], 2)
        if is_cut:
            found = cuts[index]
        if index > 0:
            part = part.filter(F.col("v") > F.lit(cuts[index - 1]))
        if index < len(cuts):
            part = part.filter(F.col("v") < F.lit(cuts[index]))
        size = row["count"]
    if found is None:
        found = part.orderBy("v").offset(place - 1).limit(1).first()[0]
    if timed:
        back = F.timestamp_micros(F.lit(found)).cast(kind)
        return df.sparkSession.range(1).select(back).first()[0]
    return found


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join that matches null keys and keeps the left copy of the key columns."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])
