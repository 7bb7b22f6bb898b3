"""Sources, sinks, write modes, slowly changing dimensions and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.config import Source
from tarnlake.functions.hashing import row_hash
from tarnlake.operators.incremental import (
    advance_watermarks,
    after_watermark,
    batch_watermarks,
    drop_seen,
    hash_counts,
    reset_source,
)
from tarnlake.operators.merge import scd2_history
from tarnlake.operators.upserts import merge_scd1, merge_scd2, put_keyed
from tarnlake.plans.registry import query, table
from tarnlake.session import scratch_path
from tarnlake.sources.readers import (
    read_source,
    source_page,
    source_schema,
    source_stats,
    split_bad_rows,
)
from tarnlake.sources.tables import (
    Lakehouse,
    compact,
    replace_table,
    retain_since,
    write_table,
)

CUSTOMER_SCHEMA = (
    "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
)

# --- sources --------------------------------------------------------------------


@query("src_csv", "SELECT * FROM customer")
def src_csv(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    table(spark, sf_dir, "customer").write.option("header", "true").csv(path)
    return read_source(
        spark, Source("customer", "csv", path=path, options={"schema": CUSTOMER_SCHEMA})
    )


@query(
    "src_tsv_nulls",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
           nullif(o_orderpriority, '5-LOW') AS o_orderpriority
    FROM orders
    """,
)
def src_tsv_nulls(spark, sf_dir):
    path = scratch_path(spark, "orders-tsv")
    (
        table(spark, sf_dir, "orders")
        .select(
            "o_orderkey",
            "o_custkey",
            F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        )
        .write.options(sep="\t", header="true", nullValue="\\N", compression="gzip")
        .csv(path)
    )
    options = {"sep": "\t", "null_str": "\\N", "max_age_hours": 20, "all_strings": True}
    return read_source(spark, Source("orders", "http", path=path, options=options))


@query("src_bad_rows", "SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 10 <> 3")
def src_bad_rows(spark, sf_dir):
    path = scratch_path(spark, "part-bad")
    line = F.when(F.col("p_partkey") % 10 == 3, F.concat("p_partkey", F.lit(",not a price"))).otherwise(
        F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("string"))
    )
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    schema = T.StructType(
        [T.StructField("p_partkey", T.LongType()), T.StructField("p_retailprice", T.DoubleType())]
    )
    return split_bad_rows(spark, path, schema)[0]


@query(
    "src_parquet",
    "SELECT s_suppkey AS k, s_name AS n FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer",
)
def src_parquet(spark, sf_dir):
    base = scratch_path(spark, "names")
    table(spark, sf_dir, "supplier").selectExpr("s_suppkey k", "s_name n").write.parquet(f"{base}/a")
    table(spark, sf_dir, "customer").selectExpr("c_custkey k", "c_name n").write.parquet(f"{base}/b")
    return spark.read.parquet(f"{base}/a", f"{base}/b")


@query("src_ndjson", "SELECT * FROM customer")
def src_ndjson(spark, sf_dir):
    path = scratch_path(spark, "customer-ndjson")
    table(spark, sf_dir, "customer").write.json(path)
    return read_source(
        spark, Source("customer", "ndjson", path=path, options={"schema": CUSTOMER_SCHEMA})
    )


@query("src_json_records", "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier")
def src_json_records(spark, sf_dir):
    """One response page per nation, its records under ``results``."""
    path = scratch_path(spark, "supplier-pages")
    record = F.struct(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
    )
    # Pages hold at most 50 records: the page number is part of the grouping key.
    page = F.floor(F.col("s_suppkey") / 50)
    (
        table(spark, sf_dir, "supplier")
        .groupBy("s_nationkey", page.alias("page"))
        .agg(F.collect_list(record).alias("results"))
        .select("page", "results")
        .write.json(path)
    )
    schema = "page BIGINT, results ARRAY<STRUCT<id: BIGINT, name: STRING, nation: INT>>"
    return read_source(
        spark,
        Source("pages", "rest", path=path, options={"records_key": "results", "schema": schema}),
    )


@query(
    "src_format",
    "SELECT fmt, c_custkey, c_name FROM customer, (VALUES ('parquet'), ('csv'), ('json')) AS f(fmt)",
)
def src_format(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = scratch_path(spark, f"customer-{fmt}")
        writer = customer.write.option("header", "true") if fmt == "csv" else customer.write
        writer.format(fmt).save(path)
        got = read_source(
            spark,
            Source("customer", "spark", path=path, connection={"format": fmt},
                   options={"schema": "c_custkey BIGINT, c_name STRING"}),
        ).select(F.lit(fmt).alias("fmt"), "c_custkey", "c_name")
        out = got if out is None else out.unionByName(got)
    return out


@query(
    "source_stats",
    "SELECT count(*) AS row_count, 11 AS column_count, TRUE AS has_bytes FROM lineitem",
)
def stats(spark, sf_dir):
    return source_stats(table(spark, sf_dir, "lineitem")).select(
        "row_count", "column_count", (F.col("bytes") > F.col("files")).alias("has_bytes")
    )


@query(
    "source_schema",
    """
    SELECT row_number() OVER () - 1 AS position, column_name,
           CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
             WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
             WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS column_type,
           TRUE AS nullable
    FROM (DESCRIBE lineitem)
    """,
)
def schema(spark, sf_dir):
    return source_schema(table(spark, sf_dir, "lineitem"))


@query(
    "source_sample_page",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40",
)
def sample_page(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return source_page(orders, ["o_orderkey"], limit=20, offset=40)


# --- sinks ----------------------------------------------------------------------


@query("sink_parquet_roundtrip", "SELECT * FROM orders")
def sink_parquet(spark, sf_dir):
    lake = Lakehouse(spark, scratch_path(spark, "lake"))
    lake.write(table(spark, sf_dir, "orders"), "silver_orders")
    return lake.read("silver_orders")


@query(
    "write_append",
    "SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_nationkey < 10",
)
def write_append(spark, sf_dir):
    lake = Lakehouse(spark, scratch_path(spark, "lake"))
    supplier = table(spark, sf_dir, "supplier")
    lake.append(supplier, "bronze_supplier")
    lake.append(supplier.filter("s_nationkey < 10"), "bronze_supplier")
    return lake.read("bronze_supplier")


@query(
    "sink_partitioned",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
           CAST(year(l_shipdate) AS INTEGER) AS ship_year
    FROM lineitem WHERE year(l_shipdate) = 1997
    """,
)
def sink_partitioned(spark, sf_dir):
    path = scratch_path(spark, "by-year")
    items = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
                F.year("l_shipdate").alias("ship_year"))
    )
    write_table(items, path, partition_by=["ship_year"])
    return spark.read.parquet(path).filter("ship_year = 1997")


@query(
    "sink_csv_roundtrip",
    "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1",
)
def sink_csv(spark, sf_dir):
    path = scratch_path(spark, "export-csv")
    (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
        .write.option("header", "true")
        .csv(path)
    )
    return spark.read.csv(path, header=True, schema="o_orderpriority STRING, n BIGINT, top DOUBLE")


@query("register_table", "SELECT * FROM customer")
def register_table(spark, sf_dir):
    landed = scratch_path(spark, "customer") + ".ndjson"
    table(spark, sf_dir, "customer").write.json(landed)
    lake = Lakehouse(spark, scratch_path(spark, "lake"))
    name = lake.register_file("Landed Customers-1", landed, "bronze", schema=CUSTOMER_SCHEMA)
    lake.register_views()
    return spark.table(f"bronze_{name}")


def _fragmented(spark, sf_dir) -> str:
    path = scratch_path(spark, "fragmented")
    table(spark, sf_dir, "orders").repartition(24, "o_orderkey").write.parquet(path)
    return path


@query("compact_table", "SELECT * FROM orders")
def compact_table(spark, sf_dir):
    path = _fragmented(spark, sf_dir)
    compact(spark, path)
    return spark.read.parquet(path)


@query("compact_metrics")
def compact_metrics(spark, sf_dir):
    path = _fragmented(spark, sf_dir)
    r = compact(spark, path)
    return spark.createDataFrame(
        [(r.files_before, r.files_after, r.bytes_before, r.bytes_after, r.duration_s,
          r.savings_pct)],
        "files_before bigint, files_after bigint, bytes_before bigint, bytes_after bigint, "
        "duration_s double, savings_pct double",
    )


@query(
    "retention_filter",
    "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'",
)
def retention(spark, sf_dir):
    path = scratch_path(spark, "retained")
    write_table(table(spark, sf_dir, "events"), path)
    cutoff = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    replace_table(retain_since(spark.read.parquet(path), "ts", cutoff), path)
    return spark.read.parquet(path).select("event_id", "user_id", "event_type")


# --- slowly changing dimensions -------------------------------------------------


def _price_changes(spark, sf_dir):
    """Order prices read as the change log of each customer's credit line."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.round("o_totalprice", 2).alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"),
        F.col("o_orderdate").alias("changed_at"),
        "o_orderkey",
    )


@query(
    "scd1_merge",
    """
    WITH newest AS (
      SELECT o_custkey + 3 AS k, o_totalprice AS bal, o_orderpriority AS seg FROM orders
      QUALIFY row_number() OVER (
        PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice, o_orderpriority) = 1)
    SELECT c_custkey, c_acctbal, c_mktsegment FROM customer
    WHERE c_custkey NOT IN (SELECT k FROM newest)
    UNION ALL SELECT k, bal, seg FROM newest
    """,
)
def scd1(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changes = (
        table(spark, sf_dir, "orders")
        .select(
            # Shifted keys: some changes hit known customers, the last ones are new.
            (F.col("o_custkey") + 3).alias("c_custkey"),
            F.col("o_totalprice").alias("c_acctbal"),
            F.col("o_orderpriority").alias("c_mktsegment"),
            F.col("o_orderdate").alias("changed_at"),
        )
    )
    lake = Lakehouse(spark, scratch_path(spark, "lake"))
    with lake.batch() as batch:
        put_keyed(batch, lake.key("dim_customer"), target, ["c_custkey"])
    with lake.batch() as batch:
        merge_scd1(batch, lake.key("dim_customer"), changes, ["c_custkey"], "changed_at")
    return lake.read("dim_customer")


@query(
    "scd2_history",
    """
    WITH moments AS (
      SELECT o_custkey, o_orderdate AS ts, max(o_orderpriority) AS seg
      FROM orders GROUP BY 1, 2),
    changed AS (
      SELECT * FROM moments
      QUALIFY lag(seg) OVER (PARTITION BY o_custkey ORDER BY ts) IS DISTINCT FROM seg),
    v AS (SELECT *, lead(ts) OVER (PARTITION BY o_custkey ORDER BY ts) AS nxt FROM changed)
    SELECT o_custkey AS c_custkey, seg AS c_mktsegment, ts AS effective_from,
           coalesce(strftime(nxt, '%Y-%m-%d'), 'open') AS effective_to, nxt IS NULL AS is_current
    FROM v
    """,
)
def scd2_full(spark, sf_dir):
    log = _price_changes(spark, sf_dir)
    return scd2_history(log, ["c_custkey"], "changed_at", ["c_mktsegment"]).withColumn(
        "effective_to", F.coalesce(F.date_format("effective_to", "yyyy-MM-dd"), F.lit("open"))
    )


@query(
    "scd2_merge",
    """
    WITH moments AS (
      SELECT o_custkey, o_orderdate AS ts, max(o_orderpriority) AS seg
      FROM orders GROUP BY 1, 2),
    changed AS (
      SELECT * FROM moments
      QUALIFY lag(seg) OVER (PARTITION BY o_custkey ORDER BY ts) IS DISTINCT FROM seg),
    v AS (SELECT *, lead(ts) OVER (PARTITION BY o_custkey ORDER BY ts) AS nxt FROM changed)
    SELECT o_custkey AS c_custkey, seg AS c_mktsegment, ts AS effective_from,
           coalesce(strftime(nxt, '%Y-%m-%d'), 'open') AS effective_to, nxt IS NULL AS is_current
    FROM v
    """,
)
def scd2_incremental(spark, sf_dir):
    """History up to 1997, then a batch with all later changes."""
    log = _price_changes(spark, sf_dir)
    border = F.lit("1998-01-01").cast("timestamp_ntz")
    early = log.filter(F.col("changed_at") < border)
    batch = log.filter(F.col("changed_at") >= border)
    lake = Lakehouse(spark, scratch_path(spark, "lake"))
    for changes in (early, batch):
        with lake.batch() as commit:
            merge_scd2(commit, lake.key("dim_customer"), changes, ["c_custkey"], "changed_at", ["c_mktsegment"])
    return lake.read("dim_customer").withColumn(
        "effective_to", F.coalesce(F.date_format("effective_to", "yyyy-MM-dd"), F.lit("open"))
    )


# --- incremental state ----------------------------------------------------------

MARK = "2024-01-15 00:00:00"


def _mark():
    return F.lit(MARK).cast("timestamp_ntz")


@query(
    "watermark_advance",
    """
    WITH old AS (
      SELECT event_type AS source, max(ts) AS w FROM events
      WHERE ts < TIMESTAMP '2024-01-15' OR event_type = 'view' GROUP BY 1),
    reached AS (
      SELECT event_type AS source, max(ts) AS w FROM events
      WHERE ts < TIMESTAMP '2024-01-22' AND event_type <> 'click' GROUP BY 1)
    SELECT source, greatest(old.w, coalesce(reached.w, old.w)) AS watermark
    FROM old LEFT JOIN reached USING (source)
    """,
)
def watermark_advance(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    state = batch_watermarks(
        events.filter((F.col("ts") < _mark()) | (kind == "view")), kind, "ts"
    )
    batch = events.filter(
        (F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz")) & (kind != "click")
    )
    return advance_watermarks(state, batch_watermarks(batch, kind, "ts"))


@query(
    "incremental_load",
    """
    SELECT event_id, user_id FROM events
    WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-15')
               - INTERVAL 2 HOURS
    """,
)
def incremental_load(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    mark = events.filter((F.col("event_type") == "signup") & (F.col("ts") < _mark())).agg(
        F.max("ts").cast("string")
    )
    return after_watermark(events, "ts", mark.first()[0], lateness="2 HOURS").select(
        "event_id", "user_id"
    )


@query(
    "hash_dedup",
    """
    WITH seen AS (SELECT DISTINCT event_type, user_id, CAST(value AS DECIMAL(18,2)) AS v FROM events
                  WHERE ts < TIMESTAMP '2024-01-15')
    SELECT DISTINCT event_type, user_id, value FROM events e
    WHERE ts >= TIMESTAMP '2024-01-10'
      AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.event_type = e.event_type
                      AND s.user_id = e.user_id AND s.v = CAST(e.value AS DECIMAL(18,2)))
    """,
)
def hash_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    content = ["event_type", "user_id", "value"]
    early = events.filter(F.col("ts") < _mark()).select(*content)
    seen = early.select(row_hash(early).alias("content_hash")).distinct()
    # The batch overlaps the last days already taken in.
    batch = events.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return drop_seen(batch.select(*content), seen).drop("content_hash")


@query(
    "watermark_hash_counts",
    """
    SELECT event_type AS source, max(ts) AS watermark,
           count(DISTINCT CASE WHEN event_type <> 'view' THEN user_id END) AS hash_count
    FROM events GROUP BY 1
    """,
)
def watermark_hash_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    marks = batch_watermarks(events, F.col("event_type"), "ts")
    held = events.filter("event_type <> 'view'").select(
        F.col("event_type").alias("source"), "user_id"
    )
    hashes = held.select("source", row_hash(held).alias("content_hash")).distinct()
    return hash_counts(marks, hashes)


def _replayed(spark, sf_dir, clear_hashes: bool):
    """State after a first load up to the mark, a reset, and the rows a rerun takes in."""
    events = table(spark, sf_dir, "events").withColumn("source", F.lit("events"))
    content = ["event_id", "event_type", "user_id"]
    loaded = events.filter((F.col("ts") < _mark()) & (F.col("event_type") != "error"))
    marks = batch_watermarks(loaded, "events", "ts")
    hashes = loaded.select("source", row_hash(loaded, content).alias("content_hash"))
    marks, hashes = reset_source(marks, hashes, "events", clear_hashes)
    mark = marks.filter("source = 'events'").agg(F.max("watermark").cast("string")).first()[0]
    todo = after_watermark(events, "ts", mark)
    return drop_seen(todo, hashes, content).select(*content)


@query("backfill_full", "SELECT event_id, event_type, user_id FROM events")
def backfill_full(spark, sf_dir):
    return _replayed(spark, sf_dir, clear_hashes=True)


@query(
    "backfill_keep_hashes",
    """
    SELECT event_id, event_type, user_id FROM events
    WHERE NOT (ts < TIMESTAMP '2024-01-15' AND event_type <> 'error')
    """,
)
def backfill_keep_hashes(spark, sf_dir):
    return _replayed(spark, sf_dir, clear_hashes=False)
