import datetime as dt

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from scripts.compare import TABLES, differences, duck
from tarnlake.session import scratch_path
from tarnlake.sources.tables import Lakehouse
from tarnlake.streaming import events as st

from .conftest import rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
SCHEMA = "id int, k string, ts timestamp"


def land(spark, base, *data):
    at = dt.datetime(2024, 1, 1)
    values = [(i, k, at + dt.timedelta(minutes=m)) for i, k, m in data]
    spark.createDataFrame(values, SCHEMA).write.mode("append").parquet(f"{base}/in")
    return st.file_stream(spark, f"{base}/in", spark.createDataFrame([], SCHEMA).schema)


def test_append_goes_on_from_its_checkpoint(spark):
    base = scratch_path(spark, "s")
    for part in ([(1, "a", 0)], [(2, "a", 1)]):
        st.append_to_table(land(spark, base, *part), f"{base}/out", f"{base}/c")
    assert rows(spark.read.parquet(f"{base}/out").select("id")) == [(1,), (2,)]
    st.append_to_table(land(spark, base), f"{base}/out", f"{base}/c")
    assert spark.read.parquet(f"{base}/out").count() == 2


def test_windows_split_at_their_edge(spark):
    base = scratch_path(spark, "s")
    stream = land(spark, base, (1, "a", 0), (2, "a", 59), (3, "a", 60))
    counts = st.window_counts(st.event_time(stream, "ts", "1 day"), "ts", "1 hour", ["k"])
    st.keep_updates(counts, f"{base}/w", f"{base}/c")
    got = st.latest_updates(spark, f"{base}/w", ["window_start", "k"])
    assert sorted(r["n"] for r in got.collect()) == [1, 2]


def test_updates_of_later_batches_win(spark):
    base = scratch_path(spark, "s")
    for part in ([(1, "a", 0)], [(2, "a", 5), (3, "b", 6)]):
        seen = st.last_seen(land(spark, base, *part), "ts", ["k"])
        st.keep_updates(seen, f"{base}/seen", f"{base}/c")
    got = st.latest_updates(spark, f"{base}/seen", ["k"])
    assert rows(got.select("k", "n")) == [("a", 2), ("b", 1)]
    lag = st.lag_seconds(got, F.lit("2024-01-01 00:10:00").cast("timestamp"))
    assert rows(lag.select("k", "lag_s")) == [("a", 300.0), ("b", 240.0)]


def test_copies_across_batches_are_dropped(spark):
    base = scratch_path(spark, "s")
    for part in ([(1, "a", 0), (1, "a", 0)], [(1, "a", 0), (2, "a", 1)]):
        once = st.without_copies(st.event_time(land(spark, base, *part), "ts", "1 day"), ["id", "k", "ts"])
        st.append_to_table(once.select("id"), f"{base}/out", f"{base}/c")
    assert rows(spark.read.parquet(f"{base}/out")) == [(1,), (2,)]


def test_upsert_ignores_late_rows(spark):
    base = scratch_path(spark, "s")
    for part in ([(1, "a", 10)], [(2, "a", 5), (3, "b", 1)]):
        st.upsert_table(land(spark, base, *part), f"{base}/lake", "t", f"{base}/c", ["k"], "ts")
    assert rows(Lakehouse(spark, f"{base}/lake").read("t").select("k", "id")) == [("a", 1), ("b", 3)]


def test_upsert_takes_a_repeated_delivery_once(spark):
    base = scratch_path(spark, "s")
    st.upsert_table(land(spark, base, (1, "a", 10)), f"{base}/lake", "t", f"{base}/c", ["k"], "ts")
    lake = Lakehouse(spark, f"{base}/lake")
    version = lake.manifest().version
    # The driver dies after the table's commit and before the stream's: the batch comes again.
    with lake.batch() as batch:
        batch.marks["stream_t"] = "1"
    st.upsert_table(land(spark, base, (2, "a", 20)), f"{base}/lake", "t", f"{base}/c", ["k"], "ts")
    assert lake.manifest().version > version
    assert rows(lake.read("t").select("k", "id")) == [("a", 1)]


def test_late_rows_are_counted_per_batch(spark):
    base = scratch_path(spark, "s")
    for part in ([(1, "a", 0), (2, "a", 120)], [(3, "a", 30), (4, "a", 90), (5, "a", 130)]):
        st.count_late(land(spark, base, *part), "ts", "1 HOUR", f"{base}/late", f"{base}/c")
    got = spark.read.parquet(f"{base}/late").select("batch_no", "row_count", "late_rows")
    assert rows(got) == [(0, 2, 0), (1, 3, 1)]


def test_equality_filter_on_a_stream(spark):
    base = scratch_path(spark, "s")
    stream = st.matching(land(spark, base, (1, "a", 0), (2, "b", 0)), {"k": "a", "id": 1})
    st.append_to_table(stream, f"{base}/out", f"{base}/c")
    assert spark.read.parquet(f"{base}/out").count() == 1


def test_payload_drift(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 2, "z": 1}',), (None,)], "p string")
    assert rows(st.payload_drift(df, "p", ["a", "b"])) == [("added", "z"), ("removed", "b")]


def test_scratch_uses_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from tarnlake import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_path(Session(), "x")


STREAMS = "bronze rate filter_window late late_windows last_seen error_rate dedup scd1 schema_drift".split()


@pytest.fixture(scope="module")
def any_day(spark, tmp_path_factory):
    """Tables whose events lie years apart, on one another's borders, and nowhere in time."""
    folder = tmp_path_factory.mktemp("any_day")
    for name in TABLES:
        (folder / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    (folder / "events.parquet").unlink()
    events = spark.read.parquet(f"{SF}/events.parquet")
    k = F.col("event_id")
    moved = F.when(k % 10 == 0, F.col("ts") - F.expr("INTERVAL 400 DAYS"))
    moved = moved.when(k % 10 == 1, F.col("ts") + F.expr("INTERVAL 90 DAYS"))
    moved = moved.when((k % 10 == 2) | (F.col("user_id") % 7 == 3), None).otherwise(F.col("ts"))
    events = events.withColumn("ts", moved.cast("timestamp_ntz"))
    events = events.withColumn("props", F.when(F.col("ts") > "2024-02-10", '{"unit": 1, "new": 2}').otherwise(F.col("props")))
    pq.write_table(events.toArrow(), folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", STREAMS)
def test_jobs_take_in_events_of_any_day(spark, any_day, name):
    got = QUERIES[f"stream_{name}"](spark, any_day).toPandas()
    want = duck(any_day).execute(ORACLES[f"stream_{name}"]).df()
    assert len(want) and differences(got, want) is None
