"""Privacy, audit and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions.pii import PATTERNS, kinds_in, pattern
from tarnlake.operators import graph, lineage, privacy
from tarnlake.plans.declarative import EDGES_SQL, weekly_edges
from tarnlake.plans.registry import query, table
from tarnlake.session import scratch_path
from tarnlake.sources.tables import Lakehouse

KINDS = sorted(PATTERNS)

# --- privacy --------------------------------------------------------------------

_SCAN_SQL = " UNION ALL ".join(
    f"SELECT 'text' AS column_name, '{k}' AS pii_type, "
    f"CAST(sum(len(regexp_extract_all(text, '{pattern(k)}'))) AS BIGINT) AS matches, "
    f"count(*) FILTER (regexp_matches(text, '{pattern(k)}')) AS row_count FROM documents"
    for k in KINDS
)


@query("pii_scan", _SCAN_SQL)
def pii_scan(spark, sf_dir):
    return privacy.scan(table(spark, sf_dir, "documents"), ["text"])


def _mask_sql(strategies: dict[str, str]) -> str:
    out = "text"
    for kind, (before, core, after) in PATTERNS.items():
        if kind not in strategies:
            continue
        token = "****" if strategies[kind] == "mask" else f"[{kind}]"
        if before:
            regex = f"({before[3:-1]}){core}({after[3:-1]})"
            for _ in range(2):
                out = f"regexp_replace({out}, '{regex}', '\\1{token}\\2', 'g')"
        else:
            out = f"regexp_replace({out}, '{core}', '{token}', 'g')"
    return out


MASKS = {"email": "redact", "credit_card": "mask", "ip_address": "redact", "phone": "mask",
         "ssn": "mask", "date_of_birth": "redact"}


@query(
    "pii_mask",
    f"""
    SELECT doc_id, md5({_mask_sql(MASKS)}) AS masked,
           {_mask_sql(MASKS)} <> text AS changed
    FROM documents
    """,
)
def pii_mask(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("raw"))
    masked = privacy.mask_text(documents, ["text"], MASKS)
    return masked.select(
        "doc_id", F.md5("text").alias("masked"), (F.col("text") != F.col("raw")).alias("changed")
    )


def _token_sql(text: str, kind: str) -> str:
    core = PATTERNS[kind][1]
    digest = f"substr(translate(sha256('pepper{kind}:' || z[2]), '0123456789', 'ghijklmnop'), 1, 16)"
    zipped = f"list_zip(string_split_regex({text}, '{core}'), regexp_extract_all({text}, '{core}'))"
    return f"array_to_string(list_transform({zipped}, lambda z: z[1] || coalesce('[{kind}:' || {digest} || ']', '')), '')"


@query(
    "pii_tokenize_text",
    f"""
    WITH a AS (SELECT doc_id, text, {_token_sql("text", "phone")} AS t FROM documents),
    b AS (SELECT doc_id, text, {_token_sql("t", "email")} AS t FROM a)
    SELECT doc_id, md5(t) AS tokenized, t <> text AS changed, md5(text) AS restored FROM b
    """,
)
def pii_tokenize_text(spark, sf_dir):
    """Phones and mail addresses in texts as keyed tokens, and the texts restored from the token table."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("raw"))
    made = privacy.tokenize_text(documents, "text", dict.fromkeys(("phone", "email"), "pseudonymize"), "pepper")
    made = made.withColumn("changed", F.col("text") != F.col("raw")).drop("raw")
    # Texts are searched once; the token table and the restored texts read what was found.
    made = spark.read.parquet(Lakehouse(spark, scratch_path(spark, "tokens")).write(made, "silver_tokenized"))
    both = made.withColumn("back", F.col("text"))
    both = privacy.restore_text(both, "doc_id", "back", privacy.token_table(made))
    return both.select("doc_id", F.md5("text").alias("tokenized"), "changed", F.md5("back").alias("restored"))


@query(
    "pii_pseudonymize",
    """
    SELECT c_custkey, 'p_' || substr(sha256('pepper' || c_name), 1, 16) AS c_name,
           sha256('pepper' || c_mktsegment) AS c_mktsegment, '[redacted]' AS c_acctbal,
           '****' || right(CAST(c_nationkey + 10000 AS VARCHAR), 4) AS c_nationkey
    FROM customer
    """,
)
def pii_pseudonymize(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumns(
        {
            "c_nationkey": (F.col("c_nationkey") + 10000).cast("string"),
            "c_acctbal": F.col("c_acctbal").cast("string"),
        }
    )
    fields = {"c_name": "pseudonymize", "c_mktsegment": "hash", "c_acctbal": "redact",
              "c_nationkey": "mask"}
    return privacy.protect_fields(customer, fields, secret="pepper")


@query(
    "pii_block_split",
    f"""
    SELECT doc_id, regexp_matches(text, '{pattern("credit_card")}') OR regexp_matches(text, '{pattern("ssn")}')
             AS held,
           concat_ws(',', CASE WHEN regexp_matches(text, '{pattern("credit_card")}') THEN 'credit_card' END,
                     CASE WHEN regexp_matches(text, '{pattern("ssn")}') THEN 'ssn' END) AS held_for
    FROM documents
    """,
)
def pii_block_split(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    passed, held = privacy.split_blocked(documents, "text", privacy.default_modes())
    return (
        passed.select("doc_id", F.lit(False).alias("held"), F.lit("").alias("held_for"))
        .unionByName(held.select("doc_id", F.lit(True).alias("held"), "held_for"))
    )


_ANY = " OR ".join(f"regexp_matches(text, '{pattern(k)}')" for k in KINDS)
_FIELDS = ", ".join(
    f"CASE WHEN bool_or(regexp_matches(text, '{pattern(k)}')) THEN 'text.{k}' END" for k in KINDS
)


@query(
    "pii_audit",
    f"""
    SELECT 'mask' AS operation, 'documents' AS dataset_name, concat_ws(',', {_FIELDS}) AS pii_fields,
           count(*) FILTER ({_ANY}) AS record_count, TIMESTAMP '2024-02-01 00:00:00' AS occurred_at
    FROM documents
    """,
)
def pii_audit(spark, sf_dir):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return privacy.masking_event(table(spark, sf_dir, "documents"), "documents", ["text"], at)


# --- audit log ------------------------------------------------------------------


def audit_log(spark, sf_dir):
    """Events read as audit records: errors are blocked operations."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.when(kind == "error", "blocked").otherwise(kind).alias("operation"),
        F.concat(F.lit("Table_"), (F.col("user_id") % 20).cast("string")).alias("dataset_name"),
        F.col("ts").alias("occurred_at"),
    )


@query(
    "audit_filter_counts",
    """
    WITH a AS (SELECT CASE WHEN event_type = 'error' THEN 'blocked' ELSE event_type END AS operation,
                      'Table_' || (user_id % 20) AS dataset_name, ts FROM events),
    f AS (SELECT * FROM a WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'
          AND contains(lower(dataset_name), 'le_1'))
    SELECT count(*) AS total, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-15') AS today,
           count(DISTINCT dataset_name) AS unique_tables,
           count(*) FILTER (operation = 'blocked') AS violations,
           (SELECT count(*) FROM f WHERE operation = 'click') AS clicks
    FROM f
    """,
)
def audit_filter_counts(spark, sf_dir):
    log = audit_log(spark, sf_dir)
    span = {"since": "2024-01-10", "until": "2024-01-20", "dataset_part": "LE_1"}
    clicks = privacy.filter_audit(log, operation="click", **span).agg(F.count("*")).scalar()
    counts = privacy.audit_counts(privacy.filter_audit(log, **span), "2024-01-15")
    return counts.withColumn("clicks", clicks)


@query(
    "audit_top_fields",
    "SELECT field, n FROM ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS field, count(*) AS n FROM documents WHERE regexp_matches(text, '{pattern(k)}')"
        for k in KINDS
    )
    + ") WHERE n > 0 ORDER BY n DESC, field LIMIT 5",
)
def audit_top_fields(spark, sf_dir):
    """One audit record per masked document, with the kinds masked in it."""
    found = kinds_in(F.col("text"))
    records = (
        table(spark, sf_dir, "documents")
        .select(found.alias("found"))
        .filter("found <> ''")
        .select(F.split("found", ",").alias("pii_fields"))
    )
    return privacy.top_masked_fields(records, 5)


def daily_sql(where: str, last: str, days: int) -> str:
    return f"""
    WITH days AS (SELECT CAST(unnest(generate_series(DATE '{last}' - INTERVAL {days - 1} DAY,
                              DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT strftime(day, '%Y-%m-%d') AS day, count(ts) AS n
    FROM days LEFT JOIN events ON CAST(ts AS DATE) = day AND {where} GROUP BY 1
    """


@query("audit_daily", daily_sql("TRUE", "2024-02-05", 42))
def audit_daily(spark, sf_dir):
    return privacy.audit_daily(audit_log(spark, sf_dir), "2024-02-05", 42)


# --- lineage --------------------------------------------------------------------


def conversation_events(spark, sf_dir):
    """Conversation turns as lineage events: each turn derives from the one before it."""
    turns = table(spark, sf_dir, "conversations")
    event = lambda t: F.concat("conv_id", F.lit("-"), t.cast("string"))
    return turns.select(
        "conv_id",
        "turn",
        event(F.col("turn")).alias("event_id"),
        F.when(F.col("turn") > 0, event(F.col("turn") - 1)).alias("parent_id"),
    )


@query(
    "lineage_chain",
    """
    WITH RECURSIVE last AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY 1),
    walk AS (
      SELECT conv_id || '-' || t AS start, conv_id, t, 0 AS distance FROM last
      UNION ALL SELECT start, conv_id, t - 1, distance + 1 FROM walk WHERE t > 0)
    SELECT start, conv_id || '-' || t AS node, CAST(distance AS BIGINT) AS distance FROM walk
    """,
)
def lineage_chain(spark, sf_dir):
    events = conversation_events(spark, sf_dir)
    starts = events.groupBy("conv_id").agg(F.max_by("event_id", "turn").alias("node"))
    return graph.ancestor_chain(events, "event_id", "parent_id", starts)


@query(
    "lineage_closure",
    f"""
    WITH RECURSIVE {EDGES_SQL},
    down AS (
      SELECT 'w2-click' AS node, 0 AS distance
      UNION SELECT e.child, d.distance + 1 FROM down d JOIN edges e ON e.parent = d.node),
    up AS (
      SELECT 'w2-click' AS node, 0 AS distance
      UNION SELECT e.parent, u.distance + 1 FROM up u JOIN edges e ON e.child = u.node)
    SELECT 'downstream' AS direction, node, CAST(min(distance) AS BIGINT) AS distance FROM down
    WHERE distance > 0 GROUP BY node
    UNION ALL SELECT 'upstream', node, CAST(min(distance) AS BIGINT) FROM up WHERE distance > 0 GROUP BY node
    """,
)
def lineage_closure(spark, sf_dir):
    edges = weekly_edges(table(spark, sf_dir, "events"))
    start = edges.select(F.col("parent").alias("node")).filter("node = 'w2-click'").distinct()
    parts = [
        graph.reachable(edges, start, direction).select(
            F.lit(direction).alias("direction"), "node", "distance"
        )
        for direction in ("downstream", "upstream")
    ]
    return parts[0].unionByName(parts[1])


def shipment_events(spark, sf_dir):
    """Shipments as lineage events from a supplier's nation to a customer's nation."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.lit("raw_"), F.col("s_nationkey").cast("string")).alias("source"),
            F.concat(F.lit("silver_"), F.col("c_nationkey").cast("string")).alias("destination"),
            F.col("o_orderstatus").alias("pipeline_name"),
        )
    )


_SHIPMENTS_SQL = """
    shipments AS (
      SELECT 'raw_' || s_nationkey AS source, 'silver_' || c_nationkey AS destination,
             o_orderstatus AS pipeline_name
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN supplier ON l_suppkey = s_suppkey)
"""


@query(
    "lineage_edges",
    f"WITH {_SHIPMENTS_SQL} SELECT DISTINCT source, destination, pipeline_name FROM shipments",
)
def lineage_edges(spark, sf_dir):
    return lineage.distinct_edges(shipment_events(spark, sf_dir))


@query(
    "lineage_nodes",
    f"""
    WITH {_SHIPMENTS_SQL}
    SELECT source AS node, pipeline_name FROM shipments
    UNION SELECT destination, pipeline_name FROM shipments
    """,
)
def lineage_nodes(spark, sf_dir):
    return lineage.node_pipelines(lineage.distinct_edges(shipment_events(spark, sf_dir)))


@query(
    "lineage_config_edges",
    f"""
    WITH {_SHIPMENTS_SQL}, known AS (SELECT 'raw_' || n_nationkey AS name FROM nation WHERE n_regionkey < 3)
    SELECT DISTINCT source, destination FROM shipments
    WHERE source IN (SELECT name FROM known)
    """,
)
def lineage_config_edges(spark, sf_dir):
    """Only nations of three regions are configured sources; other edges have no start."""
    nations = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    sources = nations.select(F.concat(F.lit("raw_"), F.col("n_nationkey").cast("string")).alias("name"))
    return lineage.config_edges(shipment_events(spark, sf_dir), sources)


@query(
    "lineage_summary",
    """
    SELECT CASE WHEN l_linestatus = 'O' THEN 'silver' ELSE 'bronze' END AS layer,
           l_returnflag AS operation, count(*) AS events, sum(l_quantity) AS rows_in,
           CAST(sum(l_linenumber) AS BIGINT) AS rows_out
    FROM lineitem GROUP BY 1, 2
    """,
)
def lineage_summary(spark, sf_dir):
    layer = F.when(F.col("l_linestatus") == "O", "silver").otherwise("bronze")
    events = table(spark, sf_dir, "lineitem").select(
        layer.alias("layer"),
        F.col("l_returnflag").alias("operation"),
        F.col("l_quantity").alias("input_count"),
        F.col("l_linenumber").alias("output_count"),
    )
    return lineage.summary(events)
