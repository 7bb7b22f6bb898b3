"""Tables cut from their lineage, running sums without a single task, and words as the operators see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.session import reliable_checkpoint, scratch_path

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Tables of at most so many rows (of a few bytes each) may be broadcast.
BROADCAST_ROWS = 100_000


def by_place(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with all columns but the ``needed`` ones named by their place, so that no name of the user's meets another."""
    return docs.toDF(*[c if c in needed else f"c{k}" for k, c in enumerate(docs.columns)])


def n_words(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text as an array, empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` wrote, once whatever reads them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """Mark a table for broadcast if its counted rows are few; beyond, the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Copies of one row that one task makes.
COPIES = 1_000


def repeated(df: DataFrame, times: str, copies: int = COPIES) -> DataFrame:
    """Every row as often as its column ``times`` says; the copies of one row are made by many tasks."""
    columns = [c for c in df.columns if c != times]
    parts = df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {copies}"))))
    if df.where(F.col(times) > copies).limit(1).count():
        parts = parts.repartition(*columns, "_part")
    here = F.least(F.lit(copies).cast("long"), F.col(times) - F.col("_part") * copies)
    return parts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), here))).select(*columns)


def running_sums(df: DataFrame, order: list[str], value: str, out: str, group: str | None = None) -> DataFrame:
    """Sum of ``value`` over the earlier rows, in ``order`` (within ``group``, which leads it).

    Rows are range-sorted, so a large group spans many tasks: each task sums its own range and
    one row per range and group carries the total of the ranges before it.
    """
    keys = ["_part"] + ([group] if group else [])
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = reliable_checkpoint(ranged)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part") if group is None else Window.partitionBy(group).orderBy("_part")
    totals = ranged.groupBy(*keys).agg(F.sum(value).alias("_total"))
    totals = totals.withColumn(
        "_before", F.coalesce(F.sum("_total").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_total")
    summed = ranged.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(totals, keys).withColumn(out, (F.col(out) + F.col("_before")).cast("long")).drop("_part", "_before")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
