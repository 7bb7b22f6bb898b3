"""Pipeline steps, whole pipelines and dependency depth."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.config import project_from_dict
from tarnlake.functions.scoring import ladder
from tarnlake.operators.graph import ancestor_chain, longest_depth
from tarnlake.operators.runs import Runner
from tarnlake.operators.transforms import (
    apply_steps,
    deduplicate,
    derive,
    fill_null,
    filter_rows,
    sql_step,
    stage_counts,
)
from tarnlake.plans.registry import query, table
from tarnlake.session import scratch_path
from tarnlake.sources.tables import Lakehouse


@query(
    "t_filter",
    "SELECT * FROM customer WHERE c_acctbal > 0 AND nullif(c_nationkey, 3) IS NOT NULL",
)
def t_filter(spark, sf_dir):
    return filter_rows(
        table(spark, sf_dir, "customer"), "c_acctbal > 0 AND nullif(c_nationkey, 3) IS NOT NULL"
    )


@query(
    "t_derive_tier",
    """
    SELECT o_orderkey, o_totalprice,
           CASE WHEN o_totalprice >= 400000 THEN 'excellent' WHEN o_totalprice >= 250000 THEN 'good'
                WHEN o_totalprice >= 100000 THEN 'average' ELSE 'low' END AS tier
    FROM orders
    """,
)
def t_derive_tier(spark, sf_dir):
    steps = [(400000, "excellent"), (250000, "good"), (100000, "average")]
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_totalprice")
        .withColumn("tier", ladder(F.col("o_totalprice"), steps, "low"))
    )


@query(
    "t_derive_bool",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag = 'R' AS returned FROM lineitem",
)
def t_derive_bool(spark, sf_dir):
    return derive(table(spark, sf_dir, "lineitem"), "returned", "l_returnflag = 'R'").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "returned"
    )


@query(
    "t_dedup_keep_first",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) = 1
    """,
)
def t_dedup(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"
    )
    return deduplicate(items, "l_orderkey, l_linenumber", order=["l_shipdate"]).drop("l_shipdate")


@query(
    "t_fill_null",
    """
    SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'unknown') AS c_mktsegment,
           coalesce(nullif(c_nationkey, 5), -1) AS c_nationkey
    FROM customer
    """,
)
def t_fill_null(spark, sf_dir):
    gaps = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        F.nullif("c_nationkey", F.lit(5)).alias("c_nationkey"),
    )
    return fill_null(gaps, {"c_mktsegment": "unknown", "c_nationkey": "-1"})


@query(
    "t_sql_step",
    """
    SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 100 GROUP BY n_name
    """,
)
def t_sql(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("step_nation")
    kept = filter_rows(table(spark, sf_dir, "customer"), "c_acctbal > 100")
    return sql_step(
        kept,
        """SELECT n_name, COUNT(*) AS customers, ROUND(SUM(c_acctbal), 2) AS balance
           FROM _data JOIN step_nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    )


CLEAN_ORDERS = [
    {"type": "filter", "condition": "o_totalprice > 5000 AND o_orderstatus IS NOT NULL"},
    {"type": "derive", "name": "o_orderpriority", "expression": "nullif(o_orderpriority, '5-LOW')"},
    {"type": "fill_null", "defaults": {"o_orderpriority": "none"}},
    {"type": "deduplicate", "key": ["o_custkey", "o_orderstatus"], "order": ["o_orderdate"]},
    {"type": "derive", "name": "is_large", "expression": "o_totalprice >= 250000"},
]


@query(
    "clean_orders",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
           coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS o_orderpriority,
           o_totalprice >= 250000 AS is_large
    FROM orders WHERE o_totalprice > 5000
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus
                               ORDER BY o_orderdate, o_orderkey) = 1
    """,
)
def clean_orders(spark, sf_dir):
    return apply_steps(table(spark, sf_dir, "orders"), CLEAN_ORDERS)


@query(
    "flow_stage_counts",
    """
    WITH kept AS (SELECT * FROM orders WHERE o_totalprice > 5000),
    one AS (SELECT DISTINCT o_custkey, o_orderstatus FROM kept)
    SELECT 0 AS stage, 'source' AS step, count(*) AS row_count FROM orders
    UNION ALL SELECT 1, 'filter', count(*) FROM kept
    UNION ALL SELECT 2, 'derive', count(*) FROM kept
    UNION ALL SELECT 3, 'fill_null', count(*) FROM kept
    UNION ALL SELECT 4, 'deduplicate', count(*) FROM one
    UNION ALL SELECT 5, 'derive', count(*) FROM one
    """,
)
def flow_counts(spark, sf_dir):
    return stage_counts(table(spark, sf_dir, "orders"), CLEAN_ORDERS)


def shop_project(sf_dir: str):
    """The shop example's pipelines over the order tables."""
    base = sf_dir.rstrip("/")
    return project_from_dict(
        {
            "sources": {
                "raw_customers": {"type": "parquet", "path": f"{base}/customer.parquet"},
                "raw_orders": {"type": "parquet", "path": f"{base}/orders.parquet"},
            },
            "pipelines": {
                "clean_customers": {
                    "source": "raw_customers",
                    "transforms": [
                        {"type": "filter", "condition": "c_acctbal > 0"},
                        {"type": "deduplicate", "key": ["c_custkey"]},
                    ],
                    "quality": {"completeness": 0.98, "uniqueness": ["c_custkey", "c_name"]},
                    "destination": "silver_customers",
                },
                "clean_orders": {
                    "source": "raw_orders",
                    "transforms": [
                        {"type": "filter", "condition": "o_totalprice > 0"},
                        {"type": "deduplicate", "key": ["o_orderkey"]},
                    ],
                    "quality": {"completeness": 0.99, "uniqueness": ["o_orderkey"]},
                    "destination": "silver_orders",
                    "depends_on": ["clean_customers"],
                },
                "customer_revenue": {
                    "source": "silver_orders",
                    "transforms": [
                        {
                            "type": "sql",
                            "sql": """
                                SELECT o_custkey, COUNT(*) AS order_count,
                                       ROUND(SUM(o_totalprice), 2) AS lifetime_value
                                FROM _data JOIN silver_customers ON o_custkey = c_custkey
                                GROUP BY o_custkey""",
                        }
                    ],
                    "quality": {"custom_sql": "SELECT COUNT(*) > 10 AS enough FROM _data"},
                    "destination": "gold_customer_revenue",
                    "depends_on": ["clean_orders", "clean_customers"],
                },
                "broken_gate": {
                    "source": "silver_orders",
                    "transforms": [],
                    "quality": {"uniqueness": ["o_custkey"]},
                    "destination": "gold_broken",
                    "depends_on": ["clean_orders"],
                },
            },
        }
    )


def _ran(spark, sf_dir) -> Runner:
    runner = Runner(spark, shop_project(sf_dir), Lakehouse(spark, scratch_path(spark, "lake")))
    runner.log = runner.run_all()
    return runner


@query(
    "medallion_revenue",
    """
    SELECT o_custkey, count(*) AS order_count, round(sum(o_totalprice), 2) AS lifetime_value
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_totalprice > 0 AND c_acctbal > 0 GROUP BY o_custkey
    """,
)
def medallion(spark, sf_dir):
    return _ran(spark, sf_dir).lake.read("gold_customer_revenue")


@query(
    "run_all_status",
    """
    SELECT 'clean_customers' AS job, 'success' AS status, count(*) AS rows_in,
           count(*) FILTER (c_acctbal > 0) AS rows_out FROM customer
    UNION ALL SELECT 'clean_orders', 'success', count(*), count(*) FROM orders
    UNION ALL SELECT 'customer_revenue', 'success', (SELECT count(*) FROM orders),
           count(DISTINCT o_custkey)
      FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
    UNION ALL SELECT 'broken_gate', 'failed', -1, -1
    """,
)
def run_all_status(spark, sf_dir):
    log = _ran(spark, sf_dir).log
    return log.select(
        F.col("pipeline").alias("job"),
        "status",
        F.coalesce("rows_in", F.lit(-1)).alias("rows_in"),
        F.coalesce("rows_out", F.lit(-1)).alias("rows_out"),
    )


@query("lineage_events", """
    WITH revenue AS (SELECT count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0)
    SELECT 'ingest' AS operation, 'bronze' AS layer, 'customer.parquet' AS source,
           'raw_customers' AS destination, count(*) AS input_count, count(*) AS output_count FROM customer
    UNION ALL SELECT 'ingest', 'bronze', 'orders.parquet', 'raw_orders', count(*), count(*) FROM orders
    UNION ALL SELECT 'transform', 'silver', 'raw_customers', 'silver_customers', count(*),
           count(*) FILTER (c_acctbal > 0) FROM customer
    UNION ALL SELECT 'transform', 'silver', 'raw_orders', 'silver_orders', count(*), count(*) FROM orders
    UNION ALL SELECT 'enrich', 'gold', 'silver_orders', 'gold_customer_revenue', (SELECT count(*) FROM orders), n FROM revenue
    """)  # fmt: skip
def lineage_events(spark, sf_dir):
    file = F.regexp_extract("source", "[^/]+$", 0).alias("source")
    return (
        _ran(spark, sf_dir)
        .lineage()
        .select("operation", "layer", file, "destination", "input_count", "output_count")
    )


@query("lineage_run_chain", """
    WITH revenue AS (SELECT count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0)
    SELECT 'gold_customer_revenue' AS start, 0::BIGINT AS distance, 'enrich' AS operation, 'gold_customer_revenue' AS destination, n AS row_count FROM revenue
    UNION ALL SELECT 'gold_customer_revenue', 1, 'transform', 'silver_orders', count(*) FROM orders
    UNION ALL SELECT 'gold_customer_revenue', 2, 'ingest', 'raw_orders', count(*) FROM orders
    UNION ALL SELECT 'silver_orders', 0, 'transform', 'silver_orders', count(*) FROM orders
    UNION ALL SELECT 'silver_orders', 1, 'ingest', 'raw_orders', count(*) FROM orders
    UNION ALL SELECT 'silver_customers', 0, 'transform', 'silver_customers', count(*) FILTER (c_acctbal > 0) FROM customer
    UNION ALL SELECT 'silver_customers', 1, 'ingest', 'raw_customers', count(*) FROM customer
    """)  # fmt: skip
def lineage_run_chain(spark, sf_dir):
    """Where the rows of each table that the runner wrote came from, by the parents it recorded."""
    events = _ran(spark, sf_dir).lineage()
    starts = events.filter("operation <> 'ingest'").select(F.col("event_id").alias("node"))
    chain = ancestor_chain(events, "event_id", "parent_id", starts)
    told = events.select(F.col("event_id").alias("node"), "operation", "destination", F.col("output_count").alias("row_count"))
    names = events.select(F.col("event_id").alias("event"), F.col("destination").alias("name"))
    return (
        chain.join(told, "node")
        .join(names, F.col("start") == F.col("event"))
        .select(F.col("name").alias("start"), "distance", "operation", "destination", "row_count")
    )


def orders_project(landed: str, sf_dir: str):
    """Orders loaded as they land, held to rules over several tables, into a dimension of each customer's last order."""
    return project_from_dict(
        {
            "sources": {
                "landed": {"type": "parquet", "path": landed},
                "customers": {"type": "parquet", "path": f"{sf_dir.rstrip('/')}/customer.parquet"},
            },
            "pipelines": {
                "customers": {
                    "source": "customers",
                    "transforms": [{"type": "filter", "condition": "c_acctbal > 0"}],
                    "destination": "silver_customers",
                },
                "load": {
                    "source": "landed",
                    "destination": "silver_orders",
                    "fetch_mode": "incremental",
                    "watermark_col": "o_orderdate",
                    "depends_on": ["customers"],
                    "rules": [
                        {"type": "FK", "column": "o_custkey", "ref_table": "silver_customers", "ref_col": "c_custkey", "on_failure": "skip"},
                        {"type": "RANGE", "column": "o_totalprice", "min": 50000, "on_failure": "skip"},
                        {"type": "UNIQUE", "column": "o_orderkey", "on_failure": "fail"},
                    ],
                },
                "last_order": {
                    "source": "silver_orders",
                    "destination": "gold_last_order",
                    "depends_on": ["load"],
                    "scd": {"type": 1, "key": "o_custkey", "ts": "o_orderdate"},
                },
                "price_levels": {
                    "source": "silver_orders",
                    "destination": "gold_price_levels",
                    "depends_on": ["load"],
                    "scd": {"type": 2, "key": "o_custkey", "ts": "o_orderdate", "tracked": ["o_orderpriority"]},
                },
            },
        }
    )


@query("project_two_deliveries", """
    WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0),
    marked AS (
      SELECT *, concat_ws(',', CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM c) THEN 'FK:o_custkey' END,
                          CASE WHEN o_totalprice < 50000 THEN 'RANGE:o_totalprice' END) AS broken FROM orders),
    kept AS (SELECT * FROM marked WHERE broken = ''),
    last AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1),
    moments AS (SELECT o_custkey, o_orderdate AS ts, max(o_orderpriority) AS v FROM kept GROUP BY 1, 2),
    versions AS (SELECT * FROM moments QUALIFY lag(v) OVER (PARTITION BY o_custkey ORDER BY ts) IS DISTINCT FROM v)
    SELECT 'silver_orders' AS place, count(*) AS row_count, round(sum(o_totalprice), 2) AS price FROM kept
    UNION ALL SELECT 'gold_last_order', count(*), round(sum(o_totalprice), 2) FROM last
    UNION ALL SELECT 'gold_price_levels', count(*), 0.0 FROM versions
    UNION ALL SELECT 'open versions', count(DISTINCT o_custkey), 0.0 FROM versions
    UNION ALL SELECT broken, count(*), round(sum(o_totalprice), 2) FROM marked WHERE broken <> '' GROUP BY broken
    UNION ALL SELECT 'hashes', count(*), 0.0 FROM orders
    """)  # fmt: skip
def project_two_deliveries(spark, sf_dir):
    """The project above over orders in two deliveries, every run made twice: nothing is lost or doubled."""
    landed = scratch_path(spark, "landed")
    runner = Runner(spark, orders_project(landed, sf_dir), Lakehouse(spark, scratch_path(spark, "lake")))
    orders = table(spark, sf_dir, "orders")
    border = F.lit("1998-01-01").cast("timestamp_ntz")
    for part in (orders.filter(F.col("o_orderdate") < border), orders.filter(~(F.col("o_orderdate") < border))):
        part.write.mode("append").parquet(landed)
        for _ in range(2):
            runner.run_all()
    lake, nothing = runner.lake, F.lit(0.0).alias("price")
    price = F.round(F.sum("o_totalprice"), 2).alias("price")
    n = F.count("*").alias("row_count")
    levels = lake.read("gold_price_levels")
    return functools.reduce(
        DataFrame.unionByName,
        [
            lake.read("silver_orders").agg(n, price).withColumn("place", F.lit("silver_orders")),
            lake.read("gold_last_order").agg(n, price).withColumn("place", F.lit("gold_last_order")),
            levels.agg(n, nothing).withColumn("place", F.lit("gold_price_levels")),
            levels.filter("is_current").agg(n, nothing).withColumn("place", F.lit("open versions")),
            runner.quarantine("load").groupBy(F.col("broken").alias("place")).agg(n, price),
            runner.hashes().agg(n, nothing).withColumn("place", F.lit("hashes")),
        ],
    ).select("place", "row_count", "price")


def weekly_edges(events):
    """Edges between an event type in one week and a type its user sends in a later one.

    Nodes are week and type, so the graph stays small however many events there are.
    """
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    seen = events.select("user_id", week.alias("week"), "event_type").distinct()
    a = seen.select("user_id", F.col("week").alias("w1"), F.col("event_type").alias("t1"))
    b = seen.select("user_id", (F.col("week") - 1).alias("w1"), F.col("event_type").alias("t2"))
    return (
        a.join(b, ["user_id", "w1"])
        .select(
            F.concat(F.lit("w"), F.col("w1").cast("string"), F.lit("-"), "t1").alias("parent"),
            F.concat(F.lit("w"), (F.col("w1") + 1).cast("string"), F.lit("-"), "t2").alias("child"),
        )
        .distinct()
    )


EDGES_SQL = """
    seen AS (
      SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS BIGINT)
        AS week, event_type FROM events),
    edges AS (
      SELECT DISTINCT 'w' || a.week || '-' || a.event_type AS parent,
             'w' || b.week || '-' || b.event_type AS child
      FROM seen a JOIN seen b ON a.user_id = b.user_id AND b.week = a.week + 1)
"""


@query(
    "dag_depth",
    f"""
    WITH RECURSIVE {EDGES_SQL},
    walk AS (
      SELECT DISTINCT parent AS node, 0 AS depth FROM edges
      WHERE parent NOT IN (SELECT child FROM edges)
      UNION SELECT e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node)
    SELECT node, CAST(max(depth) AS BIGINT) AS depth FROM walk GROUP BY node
    """,
)
def dag_depth(spark, sf_dir):
    return longest_depth(weekly_edges(table(spark, sf_dir, "events")))
