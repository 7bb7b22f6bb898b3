"""Run, cost, trace and alert analytics, and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions.udfs import register_function
from tarnlake.operators import oplog
from tarnlake.operators.calendars import daily_counts
from tarnlake.plans.governance import daily_sql
from tarnlake.plans.modelling import DRIFT_SQL, drift_dataset
from tarnlake.plans.registry import query, table


def run_log(spark, sf_dir):
    """Events read as runs: the user is the job, ``k`` the seconds, a high value a failure."""
    seconds = F.from_json("props", "k BIGINT")["k"]
    status = (
        F.when((F.col("event_type") == "view") & (seconds % 10 == 0), "running")
        .when(F.col("value") >= 60, "failed")
        .otherwise("success")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("finished_at"),
        status.alias("status"),
    )


RUNS_SQL = """
    runs AS (
      SELECT event_id AS run_id, 'job-' || user_id AS job, ts AS started_at,
             ts + to_seconds(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS finished_at,
             CASE WHEN event_type = 'view' AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0
                  THEN 'running' WHEN value >= 60 THEN 'failed' ELSE 'success' END AS status
      FROM events),
    newest AS (SELECT * FROM runs QUALIFY row_number() OVER (
                 PARTITION BY job ORDER BY started_at DESC, run_id DESC) = 1),
    ok AS (SELECT job, max(struct_pack(a := started_at, b := run_id)) AS k FROM runs
           WHERE status = 'success' GROUP BY 1),
    dead AS (
      SELECT r.job, count(*) AS attempts, max(started_at) AS last_failed_at
      FROM runs r LEFT JOIN ok ON r.job = ok.job
      WHERE status = 'failed' AND (ok.k IS NULL OR struct_pack(a := started_at, b := run_id) > ok.k)
      GROUP BY 1 HAVING count(*) >= 2)
"""


@query("runs_daily", daily_sql("TRUE", "2024-02-10", 126))
def runs_daily(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    return daily_counts(log, "ts", "2024-02-10", 126)


@query(
    "runs_recent",
    f"""
    WITH {RUNS_SQL}
    SELECT *, (epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0 AS duration_s
    FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 50
    """,
)
def runs_recent(spark, sf_dir):
    return oplog.recent_runs(run_log(spark, sf_dir), 50)


@query(
    "runs_success_rate",
    f"""
    WITH {RUNS_SQL}
    SELECT job, count(*) AS runs, round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate
    FROM runs GROUP BY 1
    """,
)
def runs_success_rate(spark, sf_dir):
    return oplog.success_rates(run_log(spark, sf_dir))


@query(
    "run_stats",
    f"""
    WITH {RUNS_SQL}
    SELECT count(*) AS total, count(*) FILTER (c_mktsegment <> 'BUILDING') AS scheduled,
           count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running
    FROM customer LEFT JOIN newest ON job = 'job-' || c_custkey
    """,
)
def run_stats(spark, sf_dir):
    """Customers as jobs; one market segment has no schedule."""
    jobs = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("job-"), F.col("c_custkey").cast("string")).alias("job"),
        F.when(F.col("c_mktsegment") != "BUILDING", "@daily").alias("schedule"),
    )
    return oplog.job_stats(jobs, run_log(spark, sf_dir))


@query(
    "runs_last7",
    f"""
    WITH {RUNS_SQL},
    l AS (SELECT job, started_at, run_id, CASE WHEN status = 'success' THEN 'o' ELSE 'x' END AS m
          FROM runs QUALIFY row_number() OVER (PARTITION BY job ORDER BY started_at DESC, run_id DESC) <= 7)
    SELECT job, lpad(string_agg(m, '' ORDER BY started_at, run_id), 7, '-') AS bar FROM l GROUP BY 1
    """,
)
def runs_last7(spark, sf_dir):
    return oplog.last_seven(run_log(spark, sf_dir))


@query(
    "runs_slots",
    f"""
    WITH {RUNS_SQL},
    today AS (SELECT *, row_number() OVER (ORDER BY started_at, run_id) - 1 AS i, count(*) OVER () AS n
              FROM runs WHERE CAST(started_at AS DATE) = DATE '2024-01-15'),
    placed AS (SELECT CAST(least(i // greatest(n // 7, 1), 6) AS BIGINT) AS slot, status FROM today)
    SELECT s.slot, count(status) AS runs,
           CASE WHEN count(status) = 0 THEN 'empty' WHEN bool_or(status = 'running') THEN 'running'
                WHEN bool_or(status = 'failed') THEN 'fail' ELSE 'ok' END AS status
    FROM (SELECT unnest(generate_series(0, 6)) AS slot) s LEFT JOIN placed p ON s.slot = p.slot
    GROUP BY s.slot
    """,
)
def runs_slots(spark, sf_dir):
    return oplog.day_slots(run_log(spark, sf_dir), "2024-01-15")


@query("dead_letter", f"WITH {RUNS_SQL} SELECT * FROM dead")
def dead_letter(spark, sf_dir):
    return oplog.dead_letters(run_log(spark, sf_dir))


@query(
    "cost_by_provider",
    """
    WITH s AS (SELECT event_type AS provider, sum(value) AS spend FROM events WHERE value <> 0 GROUP BY 1),
    t AS (SELECT sum(spend) AS total FROM s)
    SELECT provider, round(spend, 4) AS spend, round(spend / total, 4) AS share,
           round(least(total / 2000000.0 * 100, 100.0), 1) AS budget_pct
    FROM s, t
    """,
)
def cost_by_provider(spark, sf_dir):
    costs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("provider"), F.col("value").alias("cost_usd")
    )
    return oplog.cost_by_provider(costs, 2000000.0)


@query(
    "trace_stats",
    """
    WITH runs AS (
      SELECT conv_id, CASE WHEN conv_id % 7 = 3 THEN 'error' ELSE 'ok' END AS status,
             sum(length(text)) AS latency_ms, count(*) FILTER (role = 'assistant') AS tool_calls
      FROM conversations GROUP BY 1)
    SELECT count(*) AS total_runs, count(*) FILTER (status = 'error') AS error_count,
           round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate,
           round(avg(latency_ms), 1) AS avg_latency_ms, CAST(sum(tool_calls) AS BIGINT) AS total_tool_calls
    FROM runs
    """,
)
def trace_stats(spark, sf_dir):
    traces = (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(
            F.sum(F.length("text")).alias("latency_ms"),
            F.count_if(F.col("role") == "assistant").alias("tool_calls"),
        )
        .withColumn("status", F.when(F.col("conv_id") % 7 == 3, "error").otherwise("ok"))
    )
    return oplog.trace_stats(traces)


@query(
    "trace_assemble",
    """
    WITH runs AS (SELECT conv_id, count(*) AS steps, substring(min_by(text, turn), 1, 500) AS prompt
                  FROM conversations GROUP BY 1)
    SELECT conv_id AS run_id, turn AS step_no, role, substring(text, 1, 200) AS detail, steps, prompt
    FROM conversations JOIN runs USING (conv_id)
    """,
)
def trace_assemble(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "run_id")
    runs = turns.groupBy("run_id").agg(
        F.count("*").alias("steps"), F.min_by("text", "turn").alias("prompt")
    )
    steps = turns.select(
        "run_id", F.col("turn").alias("step_no"), "role", F.col("text").alias("detail")
    )
    return oplog.trace_steps(runs, steps, {"prompt": 500, "detail": 200})


@query(
    "log_filter",
    """
    SELECT event_id AS log_id, ts AS logged_at,
           CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING'
                WHEN 'signup' THEN 'CRITICAL' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END AS level
    FROM events WHERE event_type IN ('error', 'purchase', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 200
    """,
)
def log_filter(spark, sf_dir):
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "ERROR")
        .when(kind == "purchase", "WARNING")
        .when(kind == "signup", "CRITICAL")
        .when(kind == "click", "INFO")
        .otherwise("DEBUG")
    )
    logs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), F.col("ts").alias("logged_at"), level.alias("level")
    )
    return oplog.log_filter(logs, "warning", 200)


@query(
    "health_overlay",
    f"""
    WITH {RUNS_SQL}, r AS (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 20)
    SELECT count(*) FILTER (status = 'failed') AS recent_failures, (SELECT count(*) FROM dead) AS dead_jobs
    FROM r
    """,
)
def health_overlay(spark, sf_dir):
    return oplog.health_overlay(run_log(spark, sf_dir))


@query(
    "alert_rules",
    f"""
    WITH {RUNS_SQL},
    scores AS ({DRIFT_SQL}),
    alerts AS (
      SELECT CASE WHEN drift_detected THEN 'firing' ELSE 'quiet' END AS state, severity FROM scores
      UNION ALL SELECT 'firing', 'critical' FROM newest WHERE status = 'failed')
    SELECT state, severity, count(*) AS n FROM alerts GROUP BY 1, 2
    """,
)
def alert_rules(spark, sf_dir):
    """One rule per drift score of the line items, one per job whose newest run failed."""
    return oplog.alert_counts(oplog.alert_rules(drift_dataset(spark, sf_dir), run_log(spark, sf_dir)))


@query(
    "udf_registered",
    """
    SELECT p_partkey, 'EUR ' || CAST(CAST(floor(p_retailprice + 0.5) AS INTEGER) AS VARCHAR) AS label,
           p_size * 2 AS doubled
    FROM part
    """,
)
def udf_registered(spark, sf_dir):
    def whole_label(price: float, unit: str = "EUR") -> str:
        return f"{unit} {int(price + 0.5)}"

    def doubled(size: int) -> int:
        return size * 2

    register_function(spark, whole_label)
    register_function(spark, doubled, "double_size")
    table(spark, sf_dir, "part").createOrReplaceTempView("udf_part")
    return spark.sql(
        "SELECT p_partkey, whole_label(p_retailprice) AS label, double_size(p_size) AS doubled "
        "FROM udf_part"
    )
