"""Quality, schema contracts, catalog and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.operators import profile, quality, schema
from tarnlake.operators.quality import Rule, TableTest
from tarnlake.plans.registry import query, table
from tarnlake.session import scratch_path
from tarnlake.sources.tables import Lakehouse


def customers_with_gaps(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_name",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        F.nullif("c_nationkey", F.lit(5)).alias("c_nationkey"),
        "c_acctbal",
    )


GAPS = """
    gaps AS (SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment,
                    nullif(c_nationkey, 5) AS c_nationkey, c_acctbal FROM customer)
"""

# --- measures and rules ---------------------------------------------------------


@query(
    "q_completeness",
    f"""
    WITH {GAPS}
    SELECT count(*) AS row_count,
           round((count(c_custkey) + count(c_name) + count(c_mktsegment) + count(c_nationkey)
                  + count(c_acctbal)) / (5.0 * count(*)), 6) AS completeness,
           (count(c_custkey) + count(c_name) + count(c_mktsegment) + count(c_nationkey)
                  + count(c_acctbal)) / (5.0 * count(*)) >= 0.9 AS passed
    FROM gaps
    """,
)
def q_completeness(spark, sf_dir):
    df = customers_with_gaps(spark, sf_dir)
    return quality.measure(df, df.columns).select(
        "row_count",
        F.round("completeness", 6).alias("completeness"),
        (F.col("completeness") >= 0.9).alias("passed"),
    )


@query(
    "q_uniqueness",
    f"""
    WITH {GAPS}
    SELECT 'c_custkey' AS column_name, count(DISTINCT c_custkey) AS distinct_values,
           count(c_custkey) AS checked, round(count(DISTINCT c_custkey) / count(c_custkey), 6) AS share,
           count(DISTINCT c_custkey) = count(c_custkey) AS passed FROM gaps
    UNION ALL SELECT 'c_name', count(DISTINCT c_name), count(c_name),
           round(count(DISTINCT c_name) / count(c_name), 6),
           count(DISTINCT c_name) = count(c_name) FROM gaps
    UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(c_mktsegment),
           round(count(DISTINCT c_mktsegment) / count(c_mktsegment), 6),
           count(DISTINCT c_mktsegment) = count(c_mktsegment) FROM gaps
    """,
)
def q_uniqueness(spark, sf_dir):
    df = customers_with_gaps(spark, sf_dir)
    return quality.uniqueness(df, ["c_custkey", "c_name", "c_mktsegment"]).withColumn(
        "share", F.round("share", 6)
    )


@query(
    "q_row_count",
    "SELECT count(*) AS row_count, count(*) >= 1000 AS passed FROM orders",
)
def q_row_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("row_count"), (F.count("*") >= 1000).alias("passed")
    )


@query(
    "q_custom_sql",
    "SELECT count(*) > 100 AND avg(o_totalprice) BETWEEN 200000 AND 300000 AS passed FROM orders",
)
def q_custom_sql(spark, sf_dir):
    return quality.custom_check(
        table(spark, sf_dir, "orders"),
        "SELECT COUNT(*) > 100 AND AVG(o_totalprice) BETWEEN 200000 AND 300000 AS ok FROM _data",
    )


CUSTOMER_RULES = [
    Rule("NULL", "c_mktsegment"),
    Rule("TYPE", "c_name", {"type": "int"}),
    Rule("UNIQUE", "c_nationkey"),
    Rule("UNIQUE", "c_custkey"),
    Rule("RANGE", "c_acctbal", {"min": 0, "max": 9000}, on_failure="skip"),
    Rule("ENUM", "c_mktsegment", {"allowed": ["MACHINERY", "AUTOMOBILE"]}, on_failure="skip"),
    Rule("PATTERN", "c_name", {"pattern": "^Customer#[0-9]{9}$"}),
    Rule("EXPR", None, {"expr": "c_acctbal > 100 OR c_nationkey < 20"}),
    Rule("NULL", "c_custkey", enabled=False),
]


@query(
    "q_rules",
    f"""
    WITH {GAPS},
    raw AS (
      SELECT 'NULL:c_mktsegment' AS rule, count(*) AS checked,
             count(*) FILTER (c_mktsegment IS NULL) AS failed FROM gaps
      UNION ALL SELECT 'TYPE:c_name', count(c_name),
             count(*) FILTER (TRY_CAST(c_name AS INTEGER) IS NULL AND c_name IS NOT NULL) FROM gaps
      UNION ALL SELECT 'UNIQUE:c_nationkey', CAST(sum(n) AS BIGINT), CAST(sum(n) FILTER (n > 1) AS BIGINT)
        FROM (SELECT count(*) AS n FROM gaps WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey)
      UNION ALL SELECT 'UNIQUE:c_custkey', count(c_custkey), 0 FROM gaps
      UNION ALL SELECT 'RANGE:c_acctbal', count(c_acctbal),
             count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000) FROM gaps
      UNION ALL SELECT 'ENUM:c_mktsegment', count(c_mktsegment),
             count(*) FILTER (c_mktsegment NOT IN ('MACHINERY', 'AUTOMOBILE')) FROM gaps
      UNION ALL SELECT 'PATTERN:c_name', count(c_name),
             count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]{{9}}$')) FROM gaps
      UNION ALL SELECT 'EXPR:row', count(*),
             count(*) FILTER (NOT (c_acctbal > 100 OR c_nationkey < 20)) FROM gaps)
    SELECT rule, checked, failed, round(1 - failed / checked, 6) AS pass_pct, failed = 0 AS passed
    FROM raw
    """,
)
def q_rules(spark, sf_dir):
    return quality.evaluate_rules(customers_with_gaps(spark, sf_dir), CUSTOMER_RULES)


@query(
    "q_rule_fk",
    """
    WITH ref AS (SELECT n_nationkey FROM nation WHERE n_nationkey <> 7)
    SELECT 'FK:c_nationkey' AS rule, count(c_nationkey) AS checked,
           count(*) FILTER (c_nationkey NOT IN (SELECT n_nationkey FROM ref)) AS failed,
           round(1 - count(*) FILTER (c_nationkey NOT IN (SELECT n_nationkey FROM ref)) / count(*), 6)
             AS pass_pct,
           count(*) FILTER (c_nationkey NOT IN (SELECT n_nationkey FROM ref)) = 0 AS passed
    FROM customer
    """,
)
def q_rule_fk(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").filter("n_nationkey <> 7")
    return quality.foreign_key_rule(
        table(spark, sf_dir, "customer"), "c_nationkey", nations, "n_nationkey"
    )


@query(
    "q_split_quarantine",
    f"""
    WITH {GAPS}
    SELECT c_custkey,
           concat_ws(',', CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'RANGE:c_acctbal' END,
             CASE WHEN c_mktsegment NOT IN ('MACHINERY', 'AUTOMOBILE') THEN 'ENUM:c_mktsegment' END)
             AS broken
    FROM gaps
    """,
)
def q_split(spark, sf_dir):
    kept, held = quality.split_rows(customers_with_gaps(spark, sf_dir), CUSTOMER_RULES)
    return (
        kept.withColumn("broken", F.lit("")).unionByName(held).select("c_custkey", "broken")
    )


@query(
    "q_tests",
    """
    SELECT 'not_null:event_type' AS test, 0.0 AS observed, TRUE AS passed
    UNION ALL SELECT 'unique:user_id', CAST(sum(n) AS DOUBLE), FALSE
      FROM (SELECT count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1)
    UNION ALL SELECT 'range:value', CAST(count(*) AS DOUBLE), count(*) = 0
      FROM events WHERE value < 1 OR value > 400
    UNION ALL SELECT 'freshness:ts',
      (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(ts))) / 1000000.0,
      (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(ts))) / 1000000.0 <= 86400
      FROM events
    UNION ALL SELECT 'row_count:table', CAST(count(*) AS DOUBLE), count(*) >= 500 FROM events
    """,
)
def q_tests(spark, sf_dir):
    tests = [
        TableTest("not_null", "event_type"),
        TableTest("unique", "user_id"),
        TableTest("range", "value", "1,400"),
        TableTest("freshness", "ts", "86400"),
        TableTest("row_count", None, "500"),
    ]
    now = F.lit("2024-01-31 12:00:00").cast("timestamp")
    return quality.run_table_tests(table(spark, sf_dir, "events"), tests, now)


@query(
    "q_gate",
    f"""
    WITH {GAPS},
    m AS (
      SELECT count(*) AS row_count,
             (count(c_name) + count(c_mktsegment)) / (2.0 * count(*)) AS completeness,
             count(DISTINCT c_custkey) / count(c_custkey) AS uniqueness,
             avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.5 END) AS validity
      FROM gaps)
    SELECT 'silver' AS layer, row_count, round(completeness, 6) AS completeness,
           round(uniqueness, 6) AS uniqueness, round(validity, 6) AS validity,
           round((completeness + uniqueness + validity) / 3, 6) AS score,
           (completeness + uniqueness + validity) / 3 >= 0.75 AS passed
    FROM m
    """,
)
def q_gate(spark, sf_dir):
    scorer = F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.5)
    out = quality.gate(
        customers_with_gaps(spark, sf_dir), ["c_name", "c_mktsegment"], "c_custkey", scorer, "silver"
    )
    dims = ["completeness", "uniqueness", "validity", "score"]
    return out.withColumns({d: F.round(d, 6) for d in dims})


@query(
    "q_all_tables",
    f"""
    WITH {GAPS},
    m AS (
      SELECT 'customers' AS table_name, count(*) AS row_count,
             (count(c_custkey) + count(c_name) + count(c_mktsegment) + count(c_nationkey)
              + count(c_acctbal)) / (5.0 * count(*)) AS completeness,
             count(DISTINCT c_custkey) / count(c_custkey) AS uniqueness FROM gaps
      UNION ALL SELECT 'suppliers', count(*), 1.0, count(DISTINCT s_nationkey) / count(s_nationkey)
        FROM supplier
      UNION ALL SELECT 'nations', count(*), 1.0, 1.0 FROM nation),
    s AS (SELECT *, (completeness + uniqueness) / 2 AS score FROM m)
    SELECT table_name, row_count, round(completeness, 6) AS completeness,
           round(uniqueness, 6) AS uniqueness, round(score, 6) AS score, score >= 0.8 AS passed,
           round((SELECT avg(score) FROM s), 6) AS overall
    FROM s
    """,
)
def q_all_tables(spark, sf_dir):
    checked = quality.check_tables(
        {
            "customers": (customers_with_gaps(spark, sf_dir), ["c_custkey"]),
            "suppliers": (table(spark, sf_dir, "supplier"), ["s_nationkey"]),
            "nations": (table(spark, sf_dir, "nation"), ["n_nationkey"]),
        },
        threshold=0.8,
    )
    overall = checked.agg(F.avg("score")).scalar()
    rounded = {c: F.round(c, 6) for c in ("completeness", "uniqueness", "score")}
    return checked.withColumn("overall", F.round(overall, 6)).withColumns(rounded)


@query(
    "q_check_summary",
    f"""
    WITH {GAPS}
    SELECT 'customers' AS job, 3 AS checks, 2 AS passed, 1 AS failed
    FROM gaps HAVING count(DISTINCT c_custkey) = count(*)
    UNION ALL SELECT 'orders', 2, 2, 0 FROM orders HAVING count(*) >= 100
    """,
)
def q_check_summary(spark, sf_dir):
    """Configured checks per job with their real results."""
    from tarnlake.config import Quality

    configured = {
        "customers": (
            customers_with_gaps(spark, sf_dir),
            Quality(completeness=0.9, uniqueness=["c_custkey", "c_mktsegment"]),
        ),
        "orders": (
            table(spark, sf_dir, "orders"),
            Quality(row_count_min=100, custom_sql="SELECT MIN(o_totalprice) > 0 AS ok FROM _data"),
        ),
    }
    rows = []
    for job, (df, gate) in configured.items():
        results = quality.check_pipeline(df, gate)
        good = sum(1 for _, _, ok in results if ok)
        rows.append((job, len(results), good, len(results) - good))
    return spark.createDataFrame(rows, "job string, checks bigint, passed bigint, failed bigint")


@query(
    "audit_report",
    """
    WITH t AS (
      SELECT count(*) AS n, count(*) FILTER (nullif(l_tax, 0) IS NULL) AS no_tax,
             count(*) FILTER (l_discount = 0) AS zero_discount,
             count(*) FILTER (l_extendedprice > 100000) AS price_outlier,
             count(*) FILTER (l_shipdate > TIMESTAMP '2001-06-01') AS future_date,
             count(*) FILTER (l_shipdate < TIMESTAMP '1996-01-01') AS old_date,
             count(*) FILTER (trim(l_returnflag) = '') AS empty_flag FROM lineitem),
    d AS (SELECT CAST(sum(c) AS BIGINT) AS duplicates FROM
      (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)),
    o AS (SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN
      (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')),
    r AS (
      SELECT 'null_tax' AS check_name, no_tax AS n FROM t
      UNION ALL SELECT 'zero_discount', zero_discount FROM t
      UNION ALL SELECT 'price_outlier', price_outlier FROM t
      UNION ALL SELECT 'future_date', future_date FROM t
      UNION ALL SELECT 'old_date', old_date FROM t
      UNION ALL SELECT 'empty_flag', empty_flag FROM t
      UNION ALL SELECT 'duplicate_key', duplicates FROM d
      UNION ALL SELECT 'orphan', orphans FROM o)
    SELECT check_name, r.n AS n, round(100.0 * r.n / t.n, 4) AS pct FROM r, t
    """,
)
def audit_report(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    shipped = F.col("l_shipdate")
    date = lambda d: F.lit(d).cast("timestamp_ntz")
    checks = {
        "null_tax": F.nullif("l_tax", F.lit(0.0)).isNull(),
        "zero_discount": F.col("l_discount") == 0,
        "price_outlier": F.col("l_extendedprice") > 100000,
        "future_date": shipped > date("2001-06-01"),
        "old_date": shipped < date("1996-01-01"),
        "empty_flag": F.trim("l_returnflag") == "",
    }
    # All row checks are counters of one scan, laid out as rows afterwards.
    wide = items.agg(*[F.count_if(c).alias(name) for name, c in checks.items()])
    rows = wide.unpivot([], list(checks), "check_name", "n")
    doubled = (
        items.groupBy("l_orderkey", "l_linenumber")
        .agg(F.count("*").alias("c"))
        .filter("c > 1")
        .agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
        .select(F.lit("duplicate_key").alias("check_name"), "n")
    )
    orphans = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
        .agg(F.count("*").alias("n"))
        .select(F.lit("orphan").alias("check_name"), "n")
    )
    total = items.agg(F.count("*")).scalar()
    return (
        rows.unionByName(doubled)
        .unionByName(orphans)
        .withColumn("pct", F.round(100.0 * F.col("n") / total, 4))
    )


# --- schema contracts -----------------------------------------------------------


def changed_orders(spark, sf_dir):
    """Orders with a column dropped, one added and one in another type."""
    return (
        table(spark, sf_dir, "orders")
        .drop("o_orderpriority")
        .withColumn("o_channel", F.lit("web"))
        .withColumn("o_custkey", F.col("o_custkey").cast("string"))
    )


@query(
    "schema_snapshot",
    """
    SELECT 'customer' AS table_name, column_name,
           CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
             WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS column_type
    FROM (DESCRIBE customer)
    """,
)
def schema_snapshot(spark, sf_dir):
    return schema.snapshot(table(spark, sf_dir, "customer"), "customer")


@query(
    "schema_diff",
    """
    WITH d AS (SELECT column_name FROM (DESCRIBE orders))
    SELECT 'orders' AS table_name, 'removed' AS kind, column_name, 'string' AS old_type,
           '-' AS new_type FROM d WHERE column_name = 'o_orderpriority'
    UNION ALL SELECT 'orders', 'type_changed', column_name, 'bigint', 'string' FROM d
      WHERE column_name = 'o_custkey'
    UNION ALL SELECT 'orders', 'added', 'o_channel', '-', 'string'
    """,
)
def schema_diff(spark, sf_dir):
    contract = schema.snapshot(table(spark, sf_dir, "orders"), "orders")
    observed = schema.snapshot(changed_orders(spark, sf_dir), "orders")
    return schema.diff(contract, observed).na.fill("-", ["old_type", "new_type"])


@query(
    "schema_accept",
    """
    WITH o AS (
      SELECT column_name, CASE WHEN column_name = 'o_custkey' THEN 'string'
               WHEN column_type = 'BIGINT' THEN 'bigint' WHEN column_type = 'VARCHAR' THEN 'string'
               WHEN column_type = 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS column_type
      FROM (DESCRIBE orders) WHERE column_name <> 'o_orderpriority')
    SELECT 'orders' AS table_name, column_name, column_type FROM o
    UNION ALL SELECT 'orders', 'o_channel', 'string'
    UNION ALL SELECT 'nation', column_name,
           CASE column_type WHEN 'INTEGER' THEN 'int' ELSE 'string' END FROM (DESCRIBE nation)
    """,
)
def schema_accept(spark, sf_dir):
    contract = schema.snapshot(table(spark, sf_dir, "orders"), "orders").unionByName(
        schema.snapshot(table(spark, sf_dir, "nation"), "nation")
    )
    observed = schema.snapshot(changed_orders(spark, sf_dir), "orders")
    events = schema.diff(contract, observed).withColumn("accepted", F.lit(False))
    _, promoted = schema.accept(events, contract, observed, F.col("table_name") == "orders")
    return promoted


@query(
    "schema_enforce",
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer",
)
def schema_enforce(spark, sf_dir):
    """A table with columns beyond its contract and a narrower key."""
    contract = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint"}
    return schema.enforce(table(spark, sf_dir, "customer"), contract)


# --- catalog and profiles -------------------------------------------------------


def _lake(spark, sf_dir) -> Lakehouse:
    lake = Lakehouse(spark, scratch_path(spark, "lake"))
    lake.write(table(spark, sf_dir, "customer"), "customers", "bronze")
    lake.write(table(spark, sf_dir, "orders"), "silver_orders")
    lake.write(
        table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")),
        "gold_orders_per_customer",
    )
    return lake


@query(
    "catalog_tables",
    """
    SELECT 'bronze' AS layer, 'customers' AS table_name, count(*) AS row_count, 5 AS column_count
    FROM customer
    UNION ALL SELECT 'silver', 'silver_orders', count(*), 6 FROM orders
    UNION ALL SELECT 'gold', 'gold_orders_per_customer', count(DISTINCT o_custkey), 2 FROM orders
    """,
)
def catalog_tables(spark, sf_dir):
    return profile.list_tables(_lake(spark, sf_dir)).select(
        "layer", "table_name", "row_count", "column_count"
    )


@query("table_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 8")
def table_preview(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "orders"), 8, order=["o_orderkey"])


@query(
    "profile_nulls",
    f"""
    WITH {GAPS}
    SELECT 'c_custkey' AS column_name, count(*) AS row_count, 0 AS nulls, 0.0 AS null_rate,
           CAST(min(c_custkey) AS VARCHAR) AS min, CAST(max(c_custkey) AS VARCHAR) AS max,
           round(avg(c_custkey), 6) AS mean FROM gaps
    UNION ALL SELECT 'c_name', count(*), 0, 0.0, min(c_name), max(c_name), -1 FROM gaps
    UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment),
           round((count(*) - count(c_mktsegment)) / count(*), 6), min(c_mktsegment),
           max(c_mktsegment), -1 FROM gaps
    UNION ALL SELECT 'c_nationkey', count(*), count(*) - count(c_nationkey),
           round((count(*) - count(c_nationkey)) / count(*), 6), CAST(min(c_nationkey) AS VARCHAR),
           CAST(max(c_nationkey) AS VARCHAR), round(avg(c_nationkey), 6) FROM gaps
    UNION ALL SELECT 'c_acctbal', count(*), 0, 0.0, CAST(min(c_acctbal) AS VARCHAR),
           CAST(max(c_acctbal) AS VARCHAR), round(avg(c_acctbal), 6) FROM gaps
    """,
)
def profile_nulls(spark, sf_dir):
    return profile.null_profile(customers_with_gaps(spark, sf_dir)).withColumn(
        "mean", F.coalesce(F.round("mean", 6), F.lit(-1.0))
    )


@query(
    "profile_top_values",
    """
    WITH cells AS (
      SELECT 'l_returnflag' AS column_name, l_returnflag AS value FROM lineitem
      UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem
      UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem),
    counts AS (SELECT column_name, value, count(*) AS n FROM cells GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank
    FROM counts QUALIFY rank <= 5
    """,
)
def profile_top_values(spark, sf_dir):
    return profile.top_values(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber", "l_suppkey"], 5
    )


@query(
    "sql_console",
    """
    SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS spent
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
    """,
)
def sql_console(spark, sf_dir):
    return profile.console(
        _lake(spark, sf_dir),
        """SELECT c_mktsegment, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS spent
           FROM silver_orders JOIN bronze_customers ON o_custkey = c_custkey
           GROUP BY c_mktsegment;""",
    )


@query(
    "sql_template",
    """
    SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE o_totalprice >= 150000.0 AND o_orderstatus = 'O' GROUP BY 1
    """,
)
def sql_template(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("template_orders")
    template = profile.SqlTemplate(
        """SELECT o_orderpriority, COUNT(*) AS n FROM template_orders
           WHERE o_totalprice >= :least AND o_orderstatus = :status GROUP BY o_orderpriority""",
        [
            profile.Param("least", "double", required=True),
            profile.Param("status", "string", default="O"),
        ],
    )
    return template.call(spark, {"least": 150000})
