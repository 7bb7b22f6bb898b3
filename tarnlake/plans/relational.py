"""Predicates, joins, aggregates, windows, sorting and scalar functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from tarnlake.functions.hashing import row_hash
from tarnlake.functions.ordered import exact_quantile, first_per_key, rank_split
from tarnlake.plans.registry import query, table

# --- predicates -----------------------------------------------------------------


@query(
    "p_null_or_zero",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, nullif(l_tax, 0.05) AS tax
    FROM lineitem
    WHERE (nullif(l_tax, 0.05) IS NULL OR l_discount = 0) AND l_quantity IS NOT NULL
    """,
)
def null_or_zero(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("tax", F.nullif("l_tax", F.lit(0.05)))
        .filter("(tax IS NULL OR l_discount = 0) AND l_quantity IS NOT NULL")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "tax")
    )


@query(
    "p_between",
    """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice BETWEEN 100000 AND 150000
      AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'
    """,
)
def between(spark, sf_dir):
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01", "1997-12-31"))
    return (
        table(spark, sf_dir, "orders")
        .filter(
            F.col("o_totalprice").between(100000, 150000)
            & F.col("o_orderdate").between(low, high)
        )
        .select("o_orderkey", "o_totalprice")
    )


@query(
    "p_ilike_any",
    """
    SELECT doc_id, source FROM documents
    WHERE text ILIKE '%WAREHOUSE%' OR text ILIKE '%the %' OR source LIKE 'src1%'
    """,
)
def ilike_any(spark, sf_dir):
    wanted = [F.col("text").ilike(p) for p in ("%WAREHOUSE%", "%the %")]
    return (
        table(spark, sf_dir, "documents")
        .filter(reduce(or_, wanted) | F.col("source").like("src1%"))
        .select("doc_id", "source")
    )


@query(
    "p_title_exact",
    """
    SELECT p_partkey, p_name FROM part
    WHERE lower(trim('  ' || upper(p_name) || ' ')) = 'red widget'
    """,
)
def title_exact(spark, sf_dir):
    stored = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))
    return (
        table(spark, sf_dir, "part")
        .filter(F.lower(F.trim(stored)) == "red widget")
        .select("p_partkey", "p_name")
    )


@query(
    "p_genre_year",
    """
    SELECT p_partkey, p_name, p_size FROM part
    WHERE p_size BETWEEN 10 AND 30 AND p_name LIKE '%red%' AND p_retailprice IS NOT NULL
      AND p_retailprice >= 910
    """,
)
def genre_year(spark, sf_dir):
    return (
        table(spark, sf_dir, "part")
        .filter(F.col("p_size").between(10, 30) & F.col("p_name").like("%red%"))
        .filter("p_retailprice IS NOT NULL AND p_retailprice >= 910")
        .select("p_partkey", "p_name", "p_size")
    )


@query(
    "p_fuzzy_title",
    """
    SELECT p_partkey, p_name, levenshtein(lower(p_name), 'smal rign') AS distance FROM part
    WHERE abs(length(p_name) - 9) <= 3 AND levenshtein(lower(p_name), 'smal rign') <= 3
    """,
)
def fuzzy_title(spark, sf_dir):
    wanted, most = "smal rign", 3
    return (
        table(spark, sf_dir, "part")
        .filter(F.abs(F.length("p_name") - len(wanted)) <= most)
        .withColumn("distance", F.levenshtein(F.lower("p_name"), F.lit(wanted)))
        .filter(F.col("distance") <= most)
        .select("p_partkey", "p_name", "distance")
    )


# --- joins ----------------------------------------------------------------------


@query(
    "j_semi",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    """,
)
def semi(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return (
        table(spark, sf_dir, "orders")
        .join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )


@query(
    "j_anti_orphans",
    """
    WITH kept AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
    big AS (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)
    SELECT 'items_without_order' AS direction, count(*) AS n FROM big
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM kept WHERE o_orderkey IS NOT NULL)
    UNION ALL
    SELECT 'orders_without_item', count(*) FROM kept
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM big WHERE l_orderkey IS NOT NULL)
    """,
)
def anti_orphans(spark, sf_dir):
    kept = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    big = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    on = F.col("l_orderkey") == F.col("o_orderkey")
    one = big.join(kept, on, "left_anti").agg(F.count("*").alias("n"))
    two = kept.join(big, on, "left_anti").agg(F.count("*").alias("n"))
    return one.select(F.lit("items_without_order").alias("direction"), "n").unionByName(
        two.select(F.lit("orders_without_item").alias("direction"), "n")
    )


@query(
    "j_expr_key",
    """
    WITH names AS (
      SELECT upper(p_name) || '  ' AS stored, count(*) AS n FROM part GROUP BY 1)
    SELECT p_partkey, p_name, n FROM part JOIN names ON lower(trim(p_name)) = lower(trim(stored))
    """,
)
def expr_key(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = (
        part.groupBy(F.concat(F.upper("p_name"), F.lit("  ")).alias("stored"))
        .agg(F.count("*").alias("n"))
    )
    return part.join(
        names, F.lower(F.trim(F.col("p_name"))) == F.lower(F.trim(F.col("stored")))
    ).select("p_partkey", "p_name", "n")


# --- aggregates -----------------------------------------------------------------


@query(
    "a_count_distinct",
    """
    SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities
    FROM orders
    """,
)
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.count_distinct("o_custkey").alias("customers"),
        F.count_distinct("o_orderpriority").alias("priorities"),
    )


@query(
    "a_null_audit",
    """
    SELECT count(*) AS total,
           CAST(sum(CASE WHEN nullif(l_tax, 0) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_tax,
           CAST(sum(CASE WHEN nullif(l_discount, 0) IS NULL THEN 1 ELSE 0 END) AS BIGINT)
             AS null_discount,
           CAST(sum(CASE WHEN l_shipdate IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_shipdate
    FROM lineitem
    """,
)
def null_audit(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("total"),
        F.count_if(F.nullif("l_tax", F.lit(0.0)).isNull()).alias("null_tax"),
        F.count_if(F.nullif("l_discount", F.lit(0.0)).isNull()).alias("null_discount"),
        F.count_if(F.col("l_shipdate").isNull()).alias("null_shipdate"),
    )


@query(
    "a_having_dups",
    """
    SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
    GROUP BY 1, 2 HAVING count(*) > 1
    """,
)
def having_dups(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
    )


@query(
    "a_bucket_hist",
    """
    SELECT CASE WHEN o_totalprice < 50000 THEN 'a <50k' WHEN o_totalprice < 150000 THEN 'b <150k'
                WHEN o_totalprice < 300000 THEN 'c <300k' ELSE 'd 300k+' END AS band,
           count(*) AS n, round(min(o_totalprice), 2) AS lowest, round(max(o_totalprice), 2) AS top
    FROM orders GROUP BY 1 ORDER BY 1
    """,
)
def bucket_hist(spark, sf_dir):
    price = F.col("o_totalprice")
    band = (
        F.when(price < 50000, "a <50k")
        .when(price < 150000, "b <150k")
        .when(price < 300000, "c <300k")
        .otherwise("d 300k+")
    )
    return (
        table(spark, sf_dir, "orders")
        .groupBy(band.alias("band"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.min(price), 2).alias("lowest"),
            F.round(F.max(price), 2).alias("top"),
        )
        .orderBy("band")
    )


@query(
    "a_token_count_hist",
    """
    SELECT lang, length(text) - length(replace(text, ',', '')) + 1 AS pieces, count(*) AS n
    FROM documents GROUP BY 1, 2
    """,
)
def token_count_hist(spark, sf_dir):
    pieces = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit(""))) + 1
    return (
        table(spark, sf_dir, "documents")
        .groupBy("lang", pieces.cast("bigint").alias("pieces"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "a_global",
    """
    SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_quantity) AS low,
           max(l_quantity) AS high, round(avg(l_discount), 6) AS avg_discount,
           round(stddev_samp(l_quantity), 6) AS sd_quantity
    FROM lineitem
    """,
)
def global_agg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.min("l_quantity").alias("low"),
        F.max("l_quantity").alias("high"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd_quantity"),
    )


@query("a_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_returnflag", "l_linestatus", "l_linenumber")
        .distinct()
    )


# --- windows, sorting, set operations -------------------------------------------


@query(
    "w_first_per_key",
    """
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
    """,
)
def first_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"
    )
    return first_per_key(
        orders,
        ["o_custkey"],
        [F.asc_nulls_last("o_orderdate"), F.asc_nulls_last("o_orderkey")],
    ).drop("o_orderdate")


@query(
    "w_global_rank_scaled",
    """
    SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice DESC) AS price_rank,
           rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS date_rank
    FROM orders
    """,
)
def global_rank(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"
    )
    # Quantile cuts need a number; whole seconds keep the order of the order dates.
    orders = orders.withColumn("day", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    ranked = rank_split(orders, [], "o_totalprice", "price_rank")
    return rank_split(ranked, ["o_orderstatus"], "day", "date_rank", descending=False).select(
        "o_orderkey", "o_totalprice", "price_rank", "date_rank"
    )


@query(
    "w_exact_median",
    "SELECT quantile_disc(l_extendedprice, 0.5) AS l_extendedprice FROM lineitem",
)
def exact_median(spark, sf_dir):
    middle = exact_quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.5)
    return spark.createDataFrame([(middle,)], "l_extendedprice double")


@query(
    "w_latest_per_key",
    """
    SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def latest_per_key(spark, sf_dir):
    newest = F.max_by(
        F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")
    ).alias("e")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(newest).select("user_id", "e.*")


@query(
    "prune_keep_n",
    """
    SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500
    """,
)
def prune_keep_n(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .orderBy(F.desc_nulls_last("ts"), F.desc("event_id"))
        .limit(500)
        .select("event_id", "user_id", "event_type")
    )


@query(
    "o_topk",
    """
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25
    """,
)
def topk(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderpriority", "o_totalprice")
        .orderBy(
            F.asc_nulls_last("o_orderpriority"), F.desc_nulls_last("o_totalprice"), "o_orderkey"
        )
        .limit(25)
    )


@query(
    "set_union_parts",
    """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 0.0 AS balance FROM customer
    UNION ALL
    SELECT s_suppkey, s_name, 'none', s_acctbal FROM supplier
    """,
)
def union_parts(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"),
    )
    return customer.unionByName(supplier, allowMissingColumns=True).na.fill(
        {"segment": "none", "balance": 0.0}
    )


# --- scalar functions -----------------------------------------------------------


@query(
    "f_try_cast",
    """
    SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand_no,
           TRY_CAST(CAST(p_retailprice AS VARCHAR) AS DOUBLE) AS price,
           TRY_CAST(p_type AS BIGINT) IS NULL AS bad_number,
           CAST(round(TRY_CAST(CAST(p_retailprice AS VARCHAR) AS DOUBLE) + 0.01) AS INTEGER)
             AS price_int
    FROM part
    """,
)
def try_cast(spark, sf_dir):
    price = F.col("p_retailprice").cast("string").try_cast("double")
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        brand.try_cast("int").alias("brand_no"),
        price.alias("price"),
        F.col("p_type").try_cast("bigint").isNull().alias("bad_number"),
        # Text to integer goes through double and round: a direct cast gives null.
        F.round(price + 0.01).cast("int").alias("price_int"),
    )


@query(
    "f_math",
    """
    SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_price,
           CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade,
           abs(o_totalprice - 200000) AS distance,
           CAST(floor(o_totalprice / 10000) AS BIGINT) * 10000 AS bucket,
           round((o_totalprice - 1000) / 499000, 6) AS scaled
    FROM orders
    """,
)
def math_functions(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(F.ln(price), 6).alias("log_price"),
        (F.floor(F.year("o_orderdate") / 10) * 10).cast("int").alias("decade"),
        F.abs(price - 200000).alias("distance"),
        (F.floor(price / 10000) * 10000).alias("bucket"),
        F.round((price - 1000) / 499000, 6).alias("scaled"),
    )


@query(
    "f_string",
    """
    SELECT p_partkey, lower(trim('  ' || p_brand || ' ')) AS brand, length(p_name) AS name_length,
           replace(p_name, ' ', '_') AS joined, p_name LIKE '%red%' AS has_red,
           p_type ILIKE 'pro%' AS is_promo, string_split(p_name, ' ')[1] AS first_word,
           len(string_split(p_name, ' ')) AS words
    FROM part
    """,
)
def string_functions(spark, sf_dir):
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.lower(F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" ")))).alias("brand"),
        F.length("p_name").alias("name_length"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("joined"),
        F.col("p_name").like("%red%").alias("has_red"),
        F.col("p_type").ilike("pro%").alias("is_promo"),
        words[0].alias("first_word"),
        F.size(words).alias("words"),
    )


@query(
    "f_json_props",
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           json_extract_string(props, '$.missing') IS NULL AS no_other
    FROM events
    """,
)
def json_props(spark, sf_dir):
    parsed = F.from_json("props", "k BIGINT")
    return table(spark, sf_dir, "events").select(
        "event_id",
        parsed["k"].alias("k"),
        F.get_json_object("props", "$.missing").isNull().alias("no_other"),
    )


@query(
    "row_hash",
    """
    WITH t AS (
      SELECT event_id, CAST(event_id AS VARCHAR) AS a, event_type AS b, props AS c,
             strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS d,
             CAST(nullif(user_id, 7) AS VARCHAR) AS e,
             CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR) AS f
      FROM events)
    SELECT event_id, sha256(
      'event_id=' || length(a) || ':' || a || 'event_type=' || length(b) || ':' || b ||
      'props=' || length(c) || ':' || c || 'ts=' || length(d) || ':' || d ||
      'user_id=' || coalesce(length(e), -1) || ':' || coalesce(e, '') ||
      'value=' || length(f) || ':' || f) AS row_hash
    FROM t
    """,
)
def hash_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("user_id", F.nullif("user_id", F.lit(7)))
    return events.select("event_id", row_hash(events).alias("row_hash"))


@query(
    "f_duration",
    """
    WITH spans AS (
      SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS a, max(ts) AS b
      FROM events GROUP BY 1, 2)
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day,
           date_diff('day', day, DATE '2024-01-31') AS age_days,
           (epoch_us(b) - epoch_us(a)) / 1000000.0 AS seconds,
           CASE WHEN epoch_us(b) - epoch_us(a) < 3600000000 THEN 'minutes'
                WHEN epoch_us(b) - epoch_us(a) < 43200000000 THEN 'hours'
                ELSE 'long' END AS band
    FROM spans
    """,
)
def duration(spark, sf_dir):
    day = F.to_date("ts")
    spans = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", day.alias("day"))
        .agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    )
    micros = F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(
        F.col("a").cast("timestamp")
    )
    seconds = micros / 1000000.0
    return spans.select(
        "user_id",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.datediff(F.lit("2024-01-31").cast("date"), "day").cast("bigint").alias("age_days"),
        seconds.alias("seconds"),
        F.when(seconds < 3600, "minutes").when(seconds < 43200, "hours").otherwise("long").alias(
            "band"
        ),
    )
