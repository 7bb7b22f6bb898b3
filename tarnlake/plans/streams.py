"""Streaming jobs over events that land in several deliveries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.plans.registry import query, table
from tarnlake.session import scratch_path
from tarnlake.sources.tables import Lakehouse
from tarnlake.streaming import events as st

DELIVERIES = 3
# A delivery is one batch and later ones hold later days, so no event is behind the watermark.
LATENESS = "10 days"


def borders(events: DataFrame) -> list[dt.date]:
    """First days of the deliveries after the first: the days of the events in equal parts."""
    day = F.to_date("ts")
    first, last = events.agg(F.min(day), F.max(day)).first()
    if first is None:
        return []
    days = (last - first).days + 1
    cuts = {first + dt.timedelta(days * k // DELIVERIES) for k in range(1, DELIVERIES)}
    return sorted(cuts - {first})


def in_deliveries(
    spark, sf_dir, run: Callable[[DataFrame, str], None], overlap: bool = False
) -> str:
    """Land all events delivery by delivery and run the job after each; returns its folder.

    Events without a time come with the first delivery; with ``overlap`` each later one
    repeats the day before it.
    """
    events = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    cuts = borders(events)
    parts = []
    for start, end in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True) if end is None else day < F.lit(end)
        if start is None:
            inside = inside | day.isNull()
        else:
            inside = inside & (day >= F.lit(start - dt.timedelta(days=1 if overlap else 0)))
        parts.append(events.filter(inside))
    return _land(spark, events.schema, parts, run)


def _land(spark, schema, parts, run) -> str:
    base = scratch_path(spark, "stream")
    landing = f"{base}/landing"
    for part in parts:
        part.write.mode("append").parquet(landing)
        run(st.file_stream(spark, landing, schema), base)
    return base


def _untimed(stream: DataFrame, base: str, keys: list[str], **aggregates: Column) -> None:
    """Aggregates of the rows without a time, which no window of a stream takes in."""
    rows = stream.filter(F.col("ts").isNull()).groupBy(F.col("ts").alias("window_start"), *keys)
    counts = rows.agg(*[c.alias(name) for name, c in aggregates.items()])
    st.keep_updates(counts, f"{base}/untimed", f"{base}/untimed_checkpoint")


def _with_untimed(spark, rows: DataFrame, base: str, keys: list[str]) -> DataFrame:
    untimed = st.latest_updates(spark, f"{base}/untimed", ["window_start", *keys])
    return rows.unionByName(untimed.withColumn("window_start", F.col("window_start").cast("timestamp")))


def _zoneless(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("stream_bronze", "SELECT * FROM events")
def stream_bronze(spark, sf_dir):
    base = in_deliveries(
        spark, sf_dir, lambda s, b: st.append_to_table(s, f"{b}/bronze", f"{b}/checkpoint")
    )
    return spark.read.parquet(f"{base}/bronze")


@query(
    "stream_rate",
    "SELECT date_trunc('minute', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_rate(spark, sf_dir):
    def run(stream, base):
        timed = st.event_time(stream, "ts", LATENESS)
        counts = st.window_counts(timed, "ts", "60 seconds", ["event_type"])
        st.keep_updates(counts, f"{base}/rates", f"{base}/checkpoint")
        _untimed(stream, base, ["event_type"], n=F.count("*"))

    base = in_deliveries(spark, sf_dir, run)
    rates = st.latest_updates(spark, f"{base}/rates", ["window_start", "event_type"])
    return _zoneless(_with_untimed(spark, rates, base, ["event_type"]), "window_start")


@query(
    "stream_filter_window",
    """
    SELECT date_trunc('minute', ts) AS window_start, user_id, count(*) AS n FROM events
    WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1, 2
    """,
)
def stream_filter_window(spark, sf_dir):
    def run(stream, base):
        odd = stream.withColumn("side", F.col("user_id") % 2)
        kept = st.matching(odd, {"event_type": "click", "side": 0})
        counts = st.window_counts(
            st.event_time(kept, "ts", LATENESS), "ts", "60 seconds", ["user_id"]
        )
        st.keep_updates(counts, f"{base}/windows", f"{base}/checkpoint")
        _untimed(kept, base, ["user_id"], n=F.count("*"))

    base = in_deliveries(spark, sf_dir, run)
    rows = st.latest_updates(spark, f"{base}/windows", ["window_start", "user_id"])
    return _zoneless(_with_untimed(spark, rows, base, ["user_id"]), "window_start")


# Deliveries in equal parts of the days that the events span, each after the first with the day before it.
DELIVERIES_SQL = f"""
    span AS (SELECT min(CAST(ts AS DATE)) AS f, max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 AS days FROM events),
    starts AS (SELECT DISTINCT f + CAST(days * k // {DELIVERIES} AS INTEGER) AS a
               FROM span, (SELECT unnest(range(1, {DELIVERIES})) AS k) WHERE days * k // {DELIVERIES} > 0
               UNION ALL SELECT NULL),
    d AS (SELECT row_number() OVER (ORDER BY a NULLS FIRST) - 1 AS batch_no, a,
                 lead(a) OVER (ORDER BY a NULLS FIRST) AS b FROM starts),
    x AS (SELECT d.batch_no, e.ts, 1 AS here FROM events e JOIN d
          ON ((d.a IS NULL OR CAST(ts AS DATE) >= d.a - 1) AND (d.b IS NULL OR CAST(ts AS DATE) < d.b))
             OR (ts IS NULL AND d.a IS NULL)),
    marks AS (SELECT d.batch_no, max(max(ts)) OVER (ORDER BY d.batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                     - INTERVAL 1 HOUR AS mark FROM d LEFT JOIN x USING (batch_no) GROUP BY 1)
"""


@query(
    "stream_late",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT batch_no, count(here) AS row_count, count(*) FILTER (ts < mark) AS late_rows
    FROM marks LEFT JOIN x USING (batch_no) GROUP BY 1
    """,
)
def stream_late(spark, sf_dir):
    """Rows and late rows of every delivery; each after the first repeats the day before it."""

    def run(stream, base):
        st.count_late(stream, "ts", "1 HOUR", f"{base}/late", f"{base}/checkpoint")

    base = in_deliveries(spark, sf_dir, run, overlap=True)
    return spark.read.parquet(f"{base}/late").select("batch_no", "row_count", "late_rows")


@query(
    "stream_late_windows",
    f"""
    WITH {DELIVERIES_SQL},
    told AS (SELECT date_trunc('hour', ts) AS window_start, mark,
                    coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark, FALSE) AS late
             FROM x JOIN marks USING (batch_no) WHERE ts IS NOT NULL)
    SELECT CASE WHEN late THEN 'late' ELSE 'closed' END AS side, window_start, count(*) AS n FROM told
    WHERE late OR window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2
    """,
)
def stream_late_windows(spark, sf_dir):
    """Hourly counts that the watermark closed, and beside them the rows that came after their hour was closed.

    An hour that the watermark has not passed is still open and not told; events without a time stand in none.
    """

    def run(stream, base):
        st.split_late(stream, "ts", "1 HOUR", "1 hour", base, f"{base}/split_checkpoint")
        counts = st.window_counts(st.event_time(stream, "ts", "1 HOUR"), "ts", "1 hour", [])
        st.append_closed(counts, f"{base}/closed", f"{base}/checkpoint")

    base = in_deliveries(spark, sf_dir, run, overlap=True)
    closed = spark.read.parquet(f"{base}/closed").select(F.lit("closed").alias("side"), "window_start", "n")
    hour = F.date_trunc("hour", "ts").cast("timestamp").alias("window_start")
    late = spark.read.parquet(f"{base}/late").groupBy(hour).agg(F.count("*").alias("n"))
    return _zoneless(closed.unionByName(late.withColumn("side", F.lit("late"))), "window_start")


@query(
    "stream_last_seen",
    """
    SELECT event_type, max(ts) AS last_seen, count(*) AS n,
           (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1000000.0 AS lag_s
    FROM events GROUP BY 1
    """,
)
def stream_last_seen(spark, sf_dir):
    def run(stream, base):
        st.keep_updates(
            st.last_seen(stream, "ts", ["event_type"]), f"{base}/seen", f"{base}/checkpoint"
        )

    base = in_deliveries(spark, sf_dir, run)
    seen = st.latest_updates(spark, f"{base}/seen", ["event_type"])
    return st.lag_seconds(seen, F.lit("2024-02-01").cast("timestamp"))


@query(
    "stream_error_rate",
    """
    WITH w AS (
      SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS window_start, event_type
      FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE ts IS NOT NULL OR k = 0)
    SELECT window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors,
           round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate
    FROM w GROUP BY 1
    """,
)
def stream_error_rate(spark, sf_dir):
    def run(stream, base):
        timed = st.event_time(stream, "ts", LATENESS)
        is_error = F.col("event_type") == "error"
        rates = st.error_rates(timed, "ts", is_error)
        st.keep_updates(rates, f"{base}/errors", f"{base}/checkpoint")
        # An event stands in four windows; one without a time is in none of them and is told once, apart.
        _untimed(stream, base, [], n=F.count("*"), errors=F.count_if(is_error))

    base = in_deliveries(spark, sf_dir, run)
    rows = st.latest_updates(spark, f"{base}/errors", ["window_start"])
    rows = _with_untimed(spark, rows, base, [])
    rate = F.round(F.col("errors") / F.col("n"), 6)
    return _zoneless(rows.withColumn("error_rate", rate), "window_start")


@query("stream_dedup", "SELECT event_id, user_id, event_type, value FROM events")
def stream_dedup(spark, sf_dir):
    """Overlapping deliveries repeat whole days; every event is kept once."""
    columns = ["event_id", "user_id", "event_type", "value", "ts"]

    def run(stream, base):
        once = st.without_copies(st.event_time(stream, "ts", LATENESS), columns)
        st.append_to_table(
            once.select("event_id", "user_id", "event_type", "value"),
            f"{base}/once",
            f"{base}/checkpoint",
        )

    base = in_deliveries(spark, sf_dir, run, overlap=True)
    return spark.read.parquet(f"{base}/once")


@query(
    "stream_scd1",
    """
    SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value, max(ts) AS ts
    FROM events GROUP BY user_id
    """,
)
def stream_scd1(spark, sf_dir):
    def run(stream, base):
        changes = stream.select("user_id", "event_type", "value", "ts")
        st.upsert_table(changes, f"{base}/lake", "users", f"{base}/checkpoint", ["user_id"], "ts")

    base = in_deliveries(spark, sf_dir, run, overlap=True)
    return Lakehouse(spark, f"{base}/lake").read("users")


@query(
    "stream_schema_drift",
    """
    WITH seen AS (SELECT DISTINCT unnest(json_keys(props)) AS key FROM events),
    known(key) AS (VALUES ('source'), ('unit'))
    SELECT 'added' AS kind, key FROM seen WHERE key NOT IN (SELECT key FROM known)
    UNION ALL SELECT 'removed', key FROM known WHERE key NOT IN (SELECT key FROM seen)
    """,
)
def stream_schema_drift(spark, sf_dir):
    """Payload keys against the contract, each finding once; a key is removed if no delivery has it."""
    numbers = set()

    def run(stream, base):
        def check(batch, number):
            numbers.add(number)
            found = st.payload_drift(batch, "props", ["source", "unit"])
            found.write.mode("overwrite").parquet(f"{base}/drift/batch_no={number}")

        st.each_batch(stream, check, f"{base}/checkpoint")

    base = in_deliveries(spark, sf_dir, run)
    found = spark.read.parquet(f"{base}/drift").groupBy("kind", "key").agg(F.countDistinct("batch_no").alias("n"))
    return found.filter((F.col("kind") == "added") | (F.col("n") == len(numbers))).select("kind", "key")
