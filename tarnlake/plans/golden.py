"""The pipelines of the movie and shop examples, on the order tables.

Parts stand for titles, line items for ratings and credits, suppliers for people.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.ordered import rank_split
from tarnlake.functions.scoring import contains_flags, decade, weighted_rating
from tarnlake.plans.registry import query, table
from tarnlake.session import reliable_checkpoint

PRIOR_VOTES, PRIOR_MEAN = 25.0, 2.5
BRANDS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6", "Brand#7"]
TYPES = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "PROMO", "ECONOMY"]
BILLED = 5


def part_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, mean rating (price in ten thousands) and lead supplier (lowest key) per part.

    The one supplier per part is a minimum, so it comes out of the same aggregate.
    """
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.count("*").alias("vote_count"),
            (F.avg("l_extendedprice") / 10000).alias("rating"),
            F.min("l_suppkey").alias("lead_supplier"),
        )
    )


def scored_parts(spark: SparkSession, sf_dir: str, min_votes: int) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ratings = part_ratings(spark, sf_dir).filter(F.col("vote_count") >= min_votes)
    return (
        part.join(ratings, part.p_partkey == ratings.l_partkey)
        .drop("l_partkey")
        .withColumn(
            "weighted_rating",
            weighted_rating(F.col("vote_count"), F.col("rating"), PRIOR_VOTES, PRIOR_MEAN),
        )
    )


@query(
    "g_silver_join",
    """
    WITH typed AS (
      SELECT o_orderkey AS order_id, c_name AS customer_name,
             TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS total,
             TRY_CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS order_year,
             TRY_CAST(c_mktsegment AS BIGINT) AS segment_no,
             o_orderstatus, o_orderpriority
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
    SELECT order_id, customer_name, total, order_year, coalesce(segment_no, -1) AS segment_no,
           CAST(floor(order_year / 10) * 10 AS INTEGER) AS decade
    FROM typed
    WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND order_year IS NOT NULL
      AND order_year BETWEEN 1996 AND 2000
    """,
)
def silver_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    year = F.date_format("o_orderdate", "yyyy").try_cast("int")
    return (
        orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW"))
        .withColumn("order_year", year)
        .filter(F.col("order_year").isNotNull() & F.col("order_year").between(1996, 2000))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("c_name").alias("customer_name"),
            F.col("o_totalprice").cast("string").try_cast("double").alias("total"),
            "order_year",
            F.coalesce(F.col("c_mktsegment").try_cast("bigint"), F.lit(-1)).alias("segment_no"),
            decade(F.col("order_year")).alias("decade"),
        )
    )


@query(
    "g_silver_in",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_name, p_type,
           TRY_CAST(CAST(p_size AS VARCHAR) AS INTEGER) AS size_no,
           TRY_CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) AS quantity
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
    WHERE p_type IN ('SMALL', 'PROMO') AND l_returnflag = 'R'
    """,
)
def silver_in(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .filter(F.col("p_type").isin("SMALL", "PROMO"))
        .select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p_name", "p_type",
            F.col("p_size").cast("string").try_cast("int").alias("size_no"),
            F.col("l_quantity").cast("string").try_cast("double").alias("quantity"),
        )
    )


@query(
    "g_explode_join",
    """
    WITH words AS (
      SELECT p_partkey, trim(w) AS word
      FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part
            WHERE p_name IS NOT NULL AND p_name <> ''))
    SELECT p_partkey, word, l_orderkey, l_suppkey, l_linenumber, s_name
    FROM words JOIN lineitem ON p_partkey = l_partkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey
    WHERE s_name IS NOT NULL
    """,
)
def explode_join(spark, sf_dir):
    words = (
        table(spark, sf_dir, "part")
        .filter("p_name IS NOT NULL AND p_name <> ''")
        .select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
        .withColumn("word", F.trim("word"))
    )
    items = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier")
    return (
        items.join(words, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .filter("s_name IS NOT NULL")
        .select("p_partkey", "word", "l_orderkey", "l_suppkey", "l_linenumber", "s_name")
    )


@query(
    "g_billing_join",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, c_name AS person_name, l_returnflag AS role,
           TRY_CAST(CAST(l_linenumber AS VARCHAR) AS INTEGER) AS billing_order
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey
    WHERE l_returnflag IN ('A', 'R') AND l_linenumber <= 5 AND c_name IS NOT NULL
      AND o_orderstatus = 'O'
    """,
)
def billing_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter(
        F.col("l_returnflag").isin("A", "R") & (F.col("l_linenumber") <= BILLED)
    )
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    customer = table(spark, sf_dir, "customer")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .filter("c_name IS NOT NULL")
        .select(
            "l_orderkey", "l_partkey", "l_suppkey",
            F.col("c_name").alias("person_name"),
            F.col("l_returnflag").alias("role"),
            F.col("l_linenumber").cast("string").try_cast("int").alias("billing_order"),
        )
    )


@query(
    "g_explode_words",
    """
    SELECT p_partkey, trim(w) AS word, p_brand, p_retailprice
    FROM (SELECT p_partkey, p_brand, p_retailprice,
                 unnest(string_split(replace(p_name, ' ', ', ,'), ',')) AS w FROM part)
    WHERE trim(w) <> ''
    """,
)
def explode_words(spark, sf_dir):
    names = F.regexp_replace("p_name", " ", ", ,")
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", "p_brand", "p_retailprice", F.explode(F.split(names, ",")).alias("w"))
        .select("p_partkey", F.trim("w").alias("word"), "p_brand", "p_retailprice")
        .filter("word <> ''")
    )


@query(
    "g_weighted_rank",
    """
    WITH r AS (
      SELECT l_partkey, count(*) AS vote_count, avg(l_extendedprice) / 10000 AS rating
      FROM lineitem GROUP BY l_partkey),
    lead_supplier AS (
      SELECT DISTINCT l_partkey, l_suppkey FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) = 1),
    scored AS (
      SELECT p_partkey, p_name, p_brand, vote_count, s_name AS supplier_name,
             round((vote_count * rating + 25.0 * 2.5) / (vote_count + 25.0), 4) AS weighted_rating
      FROM part JOIN r ON p_partkey = r.l_partkey
      LEFT JOIN lead_supplier f ON p_partkey = f.l_partkey
      LEFT JOIN supplier ON f.l_suppkey = s_suppkey
      WHERE vote_count >= 10)
    SELECT *, rank() OVER (ORDER BY weighted_rating DESC) AS global_rank,
           rank() OVER (PARTITION BY p_brand ORDER BY weighted_rating DESC) AS brand_rank
    FROM scored ORDER BY global_rank
    """,
)
def weighted_rank(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    scored = reliable_checkpoint(
        scored_parts(spark, sf_dir, 10)
        .join(supplier, F.col("lead_supplier") == F.col("s_suppkey"), "left")
        .select(
            "p_partkey", "p_name", "p_brand", "vote_count", "weighted_rating",
            F.col("s_name").alias("supplier_name"),
        )
    )
    ranked = rank_split(scored, [], "weighted_rating", "global_rank")
    ranked = rank_split(ranked, ["p_brand"], "weighted_rating", "brand_rank")
    return ranked.orderBy("global_rank")


@query(
    "g_trends",
    """
    SELECT p_brand, year(l_shipdate) AS ship_year, count(*) AS n_items,
           round(avg(l_quantity), 3) AS avg_quantity, sum(l_quantity) AS total_quantity,
           max(l_quantity) AS peak_quantity, min(l_quantity) AS floor_quantity,
           round(ln(sum(l_quantity) + 1.0) * avg(l_quantity) / 10.0, 4) AS popularity_index
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE p_brand IS NOT NULL AND p_brand <> '' AND l_quantity IS NOT NULL
    GROUP BY p_brand, ship_year
    ORDER BY ship_year DESC, popularity_index DESC
    """,
)
def trends(spark, sf_dir):
    part = table(spark, sf_dir, "part").filter("p_brand IS NOT NULL AND p_brand <> ''")
    return (
        table(spark, sf_dir, "lineitem")
        .filter("l_quantity IS NOT NULL")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand", F.year("l_shipdate").cast("bigint").alias("ship_year"))
        .agg(
            F.count("*").alias("n_items"),
            F.round(F.avg("l_quantity"), 3).alias("avg_quantity"),
            F.sum("l_quantity").alias("total_quantity"),
            F.max("l_quantity").alias("peak_quantity"),
            F.min("l_quantity").alias("floor_quantity"),
            F.round(F.ln(F.sum("l_quantity") + 1.0) * F.avg("l_quantity") / 10.0, 4).alias(
                "popularity_index"
            ),
        )
        .orderBy(F.desc_nulls_last("ship_year"), F.desc_nulls_last("popularity_index"))
    )


def career_stats(credits: DataFrame, person: list[str], least: int) -> DataFrame:
    """Per person: distinct works, mean and best value, first and last year, span.

    ``credits`` has the person columns and ``work, value, year``, one row per credit.
    """
    return (
        credits.groupBy(*person)
        .agg(
            F.count_distinct("work").alias("n_works"),
            F.round(F.avg("value"), 6).alias("avg_value"),
            F.round(F.max("value"), 1).alias("best_value"),
            F.round(F.sum("value"), 2).alias("total_value"),
            F.min("year").alias("first_year"),
            F.max("year").alias("last_year"),
            (F.max("year") - F.min("year")).alias("span_years"),
        )
        .filter(F.col("n_works") >= least)
    )


def order_facts(orders: DataFrame, least: float) -> DataFrame:
    return orders.filter(
        F.col("o_totalprice").isNotNull() & (F.col("o_totalprice") >= least)
    ).select(
        "o_custkey",
        F.col("o_orderkey").alias("work"),
        F.col("o_totalprice").alias("value"),
        F.year("o_orderdate").alias("year"),
    )


@query(
    "g_career_stats",
    """
    SELECT c_custkey, c_name, count(DISTINCT o.o_orderkey) AS n_works,
           round(avg(o_totalprice), 6) AS avg_value, round(max(o_totalprice), 1) AS best_value,
           round(sum(o_totalprice), 2) AS total_value, min(year(o_orderdate)) AS first_year,
           max(year(o_orderdate)) AS last_year,
           max(year(o_orderdate)) - min(year(o_orderdate)) AS span_years
    FROM customer JOIN orders o
      ON c_custkey = o_custkey AND o_totalprice IS NOT NULL AND o_totalprice >= 50000
    GROUP BY c_custkey, c_name HAVING count(DISTINCT o.o_orderkey) >= 2
    ORDER BY avg_value DESC, total_value DESC
    """,
)
def customer_career(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    credits = order_facts(orders, 50000).join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    return career_stats(credits, ["c_custkey", "c_name"], 2).orderBy(
        F.desc_nulls_last("avg_value"), F.desc_nulls_last("total_value")
    )


@query(
    "g_supplier_stats",
    """
    SELECT s_suppkey, s_name, count(DISTINCT l_orderkey) AS n_works,
           round(avg(o_totalprice), 6) AS avg_value, round(max(o_totalprice), 1) AS best_value,
           round(sum(o_totalprice), 2) AS total_value, min(year(o_orderdate)) AS first_year,
           max(year(o_orderdate)) AS last_year,
           max(year(o_orderdate)) - min(year(o_orderdate)) AS span_years
    FROM supplier JOIN lineitem ON s_suppkey = l_suppkey AND l_linenumber <= 5
    JOIN orders ON l_orderkey = o_orderkey AND o_totalprice >= 100000
    GROUP BY s_suppkey, s_name HAVING count(DISTINCT l_orderkey) >= 3
    ORDER BY avg_value DESC, total_value DESC
    """,
)
def supplier_career(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") <= BILLED)
    supplier = table(spark, sf_dir, "supplier")
    facts = order_facts(table(spark, sf_dir, "orders"), 100000)
    credits = items.join(facts, F.col("l_orderkey") == F.col("work")).join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey")
    )
    return career_stats(credits, ["s_suppkey", "s_name"], 3).orderBy(
        F.desc_nulls_last("avg_value"), F.desc_nulls_last("total_value")
    )


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table: scaled numbers, logs, brand and type flags, lead supplier averages."""
    part = table(spark, sf_dir, "part")
    items = table(spark, sf_dir, "lineitem")
    ratings = part_ratings(spark, sf_dir).filter("vote_count >= 5")
    by_supplier = items.groupBy(F.col("l_suppkey").alias("supp")).agg(
        F.round(F.avg("l_extendedprice") / 10000, 3).alias("avg_rating"),
        F.count_distinct("l_partkey").alias("n_parts"),
    )
    # Suppliers of a single part have no statistics; they take the defaults below.
    by_supplier = by_supplier.filter("n_parts >= 2")
    return (
        part.join(ratings, F.col("p_partkey") == F.col("l_partkey"))
        .drop("l_partkey")
        .join(by_supplier, F.col("lead_supplier") == F.col("supp"), "left")
        .select(
            "p_partkey",
            "p_name",
            F.round("rating", 4).alias("target_rating"),
            "vote_count",
            "p_size",
            F.round((F.col("p_retailprice") - 900.0) / 1100.0, 4).alias("price_norm"),
            F.round(F.coalesce(F.col("p_size"), F.lit(25)) / 50.0, 4).alias("size_norm"),
            F.round(F.ln(F.col("vote_count") + 1) / 16.0, 4).alias("log_votes_norm"),
            F.round(F.coalesce("avg_rating", F.lit(2.5)), 3).alias("supplier_avg_rating"),
            F.coalesce("n_parts", F.lit(1)).cast("bigint").alias("supplier_parts"),
            *contains_flags(F.col("p_type"), TYPES, "t_"),
            *[
                F.col("p_brand").contains(b).cast("int").alias(f"b_{b[6:]}")
                for b in BRANDS
            ],
        )
    )


_FLAG_SQL = ",\n".join(
    [f"CAST(p_type LIKE '%{t}%' AS INTEGER) AS t_{t.lower()}" for t in TYPES]
    + [f"CAST(p_brand LIKE '%{b}%' AS INTEGER) AS b_{b[6:]}" for b in BRANDS]
)

FEATURE_SQL = f"""
    WITH r AS (
      SELECT l_partkey, count(*) AS vote_count, avg(l_extendedprice) / 10000 AS rating
      FROM lineitem GROUP BY l_partkey HAVING count(*) >= 5),
    leads AS (SELECT l_partkey AS lead_part, min(l_suppkey) AS lead FROM lineitem GROUP BY 1),
    s AS (
      SELECT l_suppkey, round(avg(l_extendedprice) / 10000, 3) AS avg_rating,
             count(DISTINCT l_partkey) AS n_parts
      FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2)
    SELECT p_partkey, p_name, round(rating, 4) AS target_rating, vote_count, p_size,
           round((p_retailprice - 900.0) / 1100.0, 4) AS price_norm,
           round(coalesce(p_size, 25) / 50.0, 4) AS size_norm,
           round(ln(vote_count + 1) / 16.0, 4) AS log_votes_norm,
           round(coalesce(avg_rating, 2.5), 3) AS supplier_avg_rating,
           coalesce(n_parts, 1) AS supplier_parts,
           {_FLAG_SQL}
    FROM part JOIN r ON p_partkey = r.l_partkey
    LEFT JOIN leads ON p_partkey = lead_part
    LEFT JOIN s ON lead = s.l_suppkey
"""


@query("g_features", FEATURE_SQL)
def features(spark, sf_dir):
    return part_features(spark, sf_dir)


@query(
    "g_customer_revenue",
    """
    SELECT o_custkey AS customer_id, count(*) AS order_count,
           round(sum(o_totalprice), 2) AS total_revenue,
           round(avg(o_totalprice), 6) AS avg_order_value,
           round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 2)
             AS refunded_revenue
    FROM orders WHERE o_totalprice > 0 GROUP BY o_custkey
    """,
)
def customer_revenue(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .filter("o_totalprice > 0")
        .groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(
            F.count("*").alias("order_count"),
            F.round(F.sum("o_totalprice"), 2).alias("total_revenue"),
            F.round(F.avg("o_totalprice"), 6).alias("avg_order_value"),
            F.round(
                F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(0.0)),
                2,
            ).alias("refunded_revenue"),
        )
    )


@query(
    "g_product_performance",
    """
    SELECT l_partkey AS product_id, sum(l_quantity) AS units_sold,
           round(sum(l_extendedprice), 2) AS revenue, count(*) AS order_lines
    FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey ORDER BY revenue DESC
    """,
)
def product_performance(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .filter("l_returnflag = 'N'")
        .groupBy(F.col("l_partkey").alias("product_id"))
        .agg(
            F.sum("l_quantity").alias("units_sold"),
            F.round(F.sum("l_extendedprice"), 2).alias("revenue"),
            F.count("*").alias("order_lines"),
        )
        .orderBy(F.desc_nulls_last("revenue"))
    )


@query(
    "g_revenue_net",
    """
    SELECT l_partkey AS product_id,
           round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END), 2) AS revenue,
           sum(l_quantity) AS units,
           count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS refunds
    FROM lineitem GROUP BY l_partkey ORDER BY revenue DESC, product_id LIMIT 3
    """,
)
def revenue_net(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("product_id"))
        .agg(
            F.round(
                F.sum(
                    F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).otherwise(0.0)
                ),
                2,
            ).alias("revenue"),
            F.sum("l_quantity").alias("units"),
            F.count_if(F.col("l_returnflag") == "R").alias("refunds"),
        )
        .orderBy(F.desc_nulls_last("revenue"), "product_id")
        .limit(3)
    )


@query(
    "g_summary",
    """
    WITH ltv AS (
      SELECT c_custkey, c_name, c_mktsegment, coalesce(sum(o_totalprice), 0) AS value,
             max(o_orderdate) AS last_order
      FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3)
    SELECT c_mktsegment AS plan, count(*) AS customers,
           count(CASE WHEN last_order >= TIMESTAMP '2001-01-01' THEN 1 END) AS active,
           count(*) - count(CASE WHEN last_order >= TIMESTAMP '2001-01-01' THEN 1 END) AS churned,
           round(sum(value), 2) AS total_ltv, round(avg(value), 6) AS mean_ltv,
           arg_max(c_name, value) AS top_buyer
    FROM ltv GROUP BY 1
    """,
)
def summary(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    spend = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.sum("o_totalprice").alias("spent"), F.max("o_orderdate").alias("last_order"))
    )
    active = F.count_if(F.col("last_order") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    return (
        customer.join(spend, F.col("c_custkey") == F.col("o_custkey"), "left")
        .withColumn("value", F.coalesce("spent", F.lit(0.0)))
        .groupBy(F.col("c_mktsegment").alias("plan"))
        .agg(
            F.count("*").alias("customers"),
            active.alias("active"),
            (F.count("*") - active).alias("churned"),
            F.round(F.sum("value"), 2).alias("total_ltv"),
            F.round(F.avg("value"), 6).alias("mean_ltv"),
            F.max_by("c_name", "value").alias("top_buyer"),
        )
    )


@query(
    "g_hidden_gems",
    """
    WITH r AS (
      SELECT l_partkey, count(*) AS vote_count, avg(l_extendedprice) / 10000 AS rating
      FROM lineitem GROUP BY l_partkey HAVING count(*) >= 5)
    SELECT p_partkey, p_name, vote_count,
           round((vote_count * rating + 25.0 * 2.5) / (vote_count + 25.0), 4) AS weighted_rating
    FROM part JOIN r ON p_partkey = l_partkey WHERE vote_count <= 30
    ORDER BY weighted_rating DESC, p_partkey LIMIT 20
    """,
)
def hidden_gems(spark, sf_dir):
    return (
        scored_parts(spark, sf_dir, 5)
        .filter("vote_count <= 30")
        .select("p_partkey", "p_name", "vote_count", "weighted_rating")
        .orderBy(F.desc("weighted_rating"), "p_partkey")
        .limit(20)
    )


def billed_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that an order names in one of its first five places, as a title's billed cast."""
    items = table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") <= BILLED)
    return items.select("l_orderkey", "l_suppkey").distinct()


_CAST_SQL = """
      billed AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 5)
"""


@query(
    "g_pair_cooccurrence",
    f"""
    WITH {_CAST_SQL}
    SELECT a.l_suppkey AS person_a, b.l_suppkey AS person_b, count(*) AS titles
    FROM billed a JOIN billed b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
    GROUP BY 1, 2
    """,
)
def pair_cooccurrence(spark, sf_dir):
    cast = billed_cast(spark, sf_dir)
    # Joined, not gathered: a title may list many people in the same place.
    one = cast.select("l_orderkey", F.col("l_suppkey").alias("person_a"))
    other = cast.select("l_orderkey", F.col("l_suppkey").alias("person_b"))
    pairs = one.join(other, "l_orderkey").filter("person_a < person_b")
    return pairs.groupBy("person_a", "person_b").agg(F.count("*").alias("titles"))


@query(
    "g_shared_titles",
    f"""
    WITH {_CAST_SQL},
    pair AS (SELECT min(s_suppkey) AS a, min(s_suppkey) + 1 AS b FROM supplier)
    SELECT l_orderkey FROM billed JOIN pair ON l_suppkey IN (a, b)
    GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 2
    """,
)
def shared_titles(spark, sf_dir):
    first = table(spark, sf_dir, "supplier").agg(F.min("s_suppkey")).scalar()
    return (
        billed_cast(spark, sf_dir)
        .filter((F.col("l_suppkey") == first) | (F.col("l_suppkey") == first + 1))
        .groupBy("l_orderkey")
        .agg(F.count_distinct("l_suppkey").alias("n"))
        .filter("n = 2")
        .select("l_orderkey")
    )
