"""Structured Streaming over event sources.

Every job runs with the ``availableNow`` trigger by default: it takes in what has
arrived, stops, and continues from its checkpoint on the next call.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.config import Source
from tarnlake.functions.hashing import row_hash
from tarnlake.operators.upserts import merge_scd1
from tarnlake.sources.readers import equality_filter
from tarnlake.sources.tables import Lakehouse, path_exists

# --- sources --------------------------------------------------------------------


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"):
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def kafka_options(source: Source) -> dict[str, str]:
    """Spark's Kafka options for ``broker, topic, group_id, auto_offset_reset``."""
    c = {**source.connection, **source.options}
    out = {
        "kafka.bootstrap.servers": str(c["broker"]),
        "subscribe": str(c["topic"]),
        "startingOffsets": str(c.get("auto_offset_reset", "latest")),
    }
    if "group_id" in c:
        out["kafka.group.id"] = str(c["group_id"])
    return out


def kafka_json_stream(spark: SparkSession, source: Source, schema: str) -> DataFrame:
    """JSON payloads of a topic as typed columns beside key, offset and arrival time."""
    raw = spark.readStream.format("kafka").options(**kafka_options(source)).load()
    body = F.from_json(F.col("value").cast("string"), schema)
    return raw.select(
        F.col("key").cast("string").alias("key"),
        "topic",
        "partition",
        "offset",
        F.col("timestamp").alias("arrived_at"),
        body.alias("_body"),
    ).select("key", "topic", "partition", "offset", "arrived_at", "_body.*")


def event_time(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """The stream with ``ts`` as UTC event time and its watermark.

    Zoneless timestamps cannot carry a watermark; the session zone is UTC.
    """
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


# --- running --------------------------------------------------------------------


def drain(writer) -> None:
    """Run a prepared stream writer over everything that has arrived."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    drain(
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .option("path", path)
    )


def each_batch(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    drain(
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
    )


def keep_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Store each batch's changed aggregate rows under its batch number.

    A repeated batch overwrites its own folder, so a restart adds nothing twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    each_batch(stream, store, checkpoint, mode="update")


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every aggregate row stored by ``keep_updates``."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch_no")]
    newest = F.max_by(F.struct(*others), "batch_no").alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*")


# --- operators ------------------------------------------------------------------


def matching(stream: DataFrame, wanted: Mapping[str, Any]) -> DataFrame:
    return equality_filter(stream, wanted)


def window_counts(stream: DataFrame, ts: str, size: str, keys: Sequence[str]) -> DataFrame:
    """Events per window and key: ``window_start, keys, n``."""
    return (
        stream.groupBy(F.window(ts, size).alias("_w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("window_start"), *keys, "n")
    )


def error_rates(
    stream: DataFrame, ts: str, is_error: Column, size: str = "1 hour", slide: str = "15 minutes"
) -> DataFrame:
    """Share of errors per sliding window: ``window_start, n, errors``."""
    return (
        stream.groupBy(F.window(ts, size, slide).alias("_w"))
        .agg(F.count("*").alias("n"), F.count_if(is_error).alias("errors"))
        .select(F.col("_w.start").alias("window_start"), "n", "errors")
    )


def last_seen(stream: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """Newest event time and event count per key, for lag against the clock."""
    return stream.groupBy(*keys).agg(F.max(ts).alias("last_seen"), F.count("*").alias("n"))


def lag_seconds(seen: DataFrame, now: Column) -> DataFrame:
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(
        F.col("last_seen").cast("timestamp")
    )
    return seen.withColumn("lag_s", micros / 1000000.0)


def without_copies(stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each content once within the watermark. The stream must carry one."""
    return stream.withColumn("row_hash", row_hash(stream, columns)).dropDuplicatesWithinWatermark(
        ["row_hash"]
    )


def upsert_table(
    stream: DataFrame, root: str, name: str, checkpoint: str, pk: Sequence[str], ts: str
) -> None:
    """Merge every batch into a lakehouse table by key; the newest row of a key wins.

    A batch rewrites the buckets its keys fall into, and its number is committed with the rows: a batch
    that is delivered again after a crash changes nothing.
    """
    lake = Lakehouse(stream.sparkSession, root)
    mark = f"stream_{name}"

    def merge(rows: DataFrame, number: int) -> None:
        with lake.batch() as batch:
            if int(batch.marks.get(mark, -1)) < number:
                merge_scd1(batch, lake.key(name), rows, pk, ts)
                batch.marks[mark] = str(number)

    each_batch(stream, merge, checkpoint)


def count_late(
    stream: DataFrame, ts: str, lateness: str, path: str, checkpoint: str
) -> None:
    """Per batch ``row_count, late_rows, newest``: rows behind the earlier batches' newest time.

    The running maximum is read from the stored rows of earlier batches, so counting goes
    on correctly after a restart and a repeated batch replaces its own row.
    """
    spark = stream.sparkSession
    kind = stream.schema[ts].dataType

    def count(batch: DataFrame, number: int) -> None:
        newest = F.lit(None).cast(kind)
        if path_exists(spark, path):
            earlier = spark.read.parquet(path).filter(F.col("batch_no") < number)
            newest = earlier.agg(F.max("newest").cast(kind)).scalar()
        late = F.col(ts) < newest - F.expr(f"INTERVAL {lateness}")
        marked = batch.withColumn("_late", F.coalesce(late, F.lit(False)))
        row = marked.agg(
            F.count("*").alias("row_count"),
            F.count_if("_late").alias("late_rows"),
            F.max(ts).alias("newest"),
        )
        row.write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    each_batch(stream, count, checkpoint)


def split_late(
    stream: DataFrame, ts: str, lateness: str, size: str, path: str, checkpoint: str
) -> None:
    """Rows whose window of ``size`` had ended ``lateness`` before the newest earlier time, set apart.

    They are what a windowed aggregate with that watermark drops. Each batch overwrites its own folder of
    ``path/late`` and ``path/marks``, the newest time it held, so a repeated batch adds nothing twice.
    """
    spark = stream.sparkSession
    kind = stream.schema[ts].dataType

    def split(batch: DataFrame, number: int) -> None:
        newest = F.lit(None).cast(kind)
        if path_exists(spark, f"{path}/marks"):
            earlier = spark.read.parquet(f"{path}/marks").filter(F.col("batch_no") < number)
            newest = earlier.agg(F.max("newest").cast(kind)).scalar()
        ends = F.window(ts, size)["end"]
        late = batch.withColumn("_ends", ends).filter(F.col("_ends") <= newest - F.expr(f"INTERVAL {lateness}"))
        late.drop("_ends").write.mode("overwrite").parquet(f"{path}/late/batch_no={number}")
        # The mark comes last: a batch without one is split again.
        batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{path}/marks/batch_no={number}")

    each_batch(stream, split, checkpoint)


def append_closed(windows: DataFrame, path: str, checkpoint: str) -> None:
    """Store the windows of a watermarked aggregate once the watermark has passed their end."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    each_batch(windows, store, checkpoint, mode="append")


def payload_drift(batch: DataFrame, payload: str, expected: Sequence[str]) -> DataFrame:
    """Keys of a JSON payload column against the expected ones: ``kind, key``."""
    spark = batch.sparkSession
    seen = batch.select(F.explode(F.json_object_keys(payload)).alias("key")).distinct()
    known = spark.createDataFrame([(k,) for k in expected], "key string")
    added = seen.join(known, "key", "left_anti").select(F.lit("added").alias("kind"), "key")
    removed = known.join(seen, "key", "left_anti").select(F.lit("removed").alias("kind"), "key")
    return added.unionByName(removed)
