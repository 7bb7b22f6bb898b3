import datetime as dt

from pyspark.sql import functions as F

from tarnlake.functions.hashing import row_hash
from tarnlake.operators.incremental import (
    advance_watermarks,
    after_watermark,
    batch_watermarks,
    drop_seen,
    hash_counts,
    reset_source,
)

from .conftest import rows

T1, T2, T3 = (dt.datetime(2024, 1, d) for d in (1, 2, 3))
MARKS = "source string, watermark timestamp"


def test_watermark_never_moves_back(spark):
    state = spark.createDataFrame([("a", T2)], MARKS)
    batch = spark.createDataFrame([(T1,)], "ts timestamp")
    assert rows(advance_watermarks(state, batch_watermarks(batch, "a", "ts"))) == [("a", T2)]
    empty = batch.limit(0)
    assert rows(advance_watermarks(state, batch_watermarks(empty, "a", "ts"))) == [("a", T2)]
    new = spark.createDataFrame([(T3,)], "ts timestamp")
    assert rows(advance_watermarks(state, batch_watermarks(new, "b", "ts"))) == [("a", T2), ("b", T3)]


def test_after_watermark(spark):
    df = spark.createDataFrame([(T1,), (T2,), (T3,)], "ts timestamp")
    assert after_watermark(df, "ts", None).count() == 3
    assert after_watermark(df, "ts", T2).count() == 1
    assert after_watermark(df, "ts", T2, lateness="1 DAY").count() == 2


def test_rows_with_ambiguous_text_do_not_collide(spark):
    a = spark.createDataFrame([("1&b=2", "3")], "a string, b string")
    b = spark.createDataFrame([("1", "2&b=3")], "a string, b string")
    nulls = spark.createDataFrame([(None, "")], "a string, b string")
    empty = spark.createDataFrame([("", None)], "a string, b string")
    hashes = [df.select(row_hash(df)).first()[0] for df in (a, b, nulls, empty)]
    assert len(set(hashes)) == 4


def test_hash_ignores_column_order(spark):
    df = spark.createDataFrame([(1, 2.5, True)], "x int, y double, z boolean")
    other = df.select("z", "y", "x")
    assert df.select(row_hash(df)).first() == other.select(row_hash(other)).first()


def test_drop_seen_within_and_across_batches(spark):
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    none = spark.createDataFrame([], "content_hash string")
    first = drop_seen(batch, none)
    assert first.count() == 2
    assert drop_seen(batch, first).count() == 0


def test_reset(spark):
    marks = spark.createDataFrame([("a", T2), ("b", T3)], MARKS)
    hashes = spark.createDataFrame([("a", "h1"), ("b", "h2")], "source string, content_hash string")
    m, h = reset_source(marks, hashes, "a")
    assert rows(m) == [("b", T3)] and rows(h) == [("b", "h2")]
    m, h = reset_source(marks, hashes, "a", clear_hashes=False)
    assert rows(m) == [("a", dt.datetime(2000, 1, 1)), ("b", T3)] and h.count() == 2


def test_hash_counts_include_sources_without_hashes(spark):
    marks = spark.createDataFrame([("a", T2), ("b", T3)], MARKS)
    hashes = spark.createDataFrame([("a", "h1")], "source string, content_hash string")
    assert rows(hash_counts(marks, hashes).select("source", "hash_count")) == [("a", 1), ("b", 0)]


def test_one_hot_content_collapses_before_the_join(spark):
    hot = spark.range(1000).select(F.lit("same").alias("v"))
    none = spark.createDataFrame([], "content_hash string")
    assert drop_seen(hot, none).count() == 1
