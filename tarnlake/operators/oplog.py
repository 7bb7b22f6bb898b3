"""Analytics over run, cost, trace and alert logs.

Run tables have ``run_id, job, started_at, finished_at, status`` with a status of
``success``, ``failed`` or ``running``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.ordered import row_numbers, top_per_key

MAX_ATTEMPTS = 2
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def seconds_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / 1000000.0


def recent_runs(runs: DataFrame, limit: int = 50, job: str | None = None) -> DataFrame:
    """The newest runs, of one job if given, with their duration in seconds."""
    if job is not None:
        runs = runs.filter(F.col("job") == job)
    return (
        runs.withColumn("duration_s", seconds_between(F.col("started_at"), F.col("finished_at")))
        .orderBy(F.desc_nulls_last("started_at"), F.desc("run_id"))
        .limit(limit)
    )


def success_rates(runs: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") == "success")
    return runs.groupBy("job").agg(
        F.count("*").alias("runs"), F.round(ok / F.count("*"), 6).alias("success_rate")
    )


def last_status(runs: DataFrame) -> DataFrame:
    """``job, status, started_at, run_id`` of each job's newest run."""
    newest = F.max_by(F.struct("status", "started_at", "run_id"), F.struct("started_at", "run_id"))
    return runs.groupBy("job").agg(newest.alias("r")).select("job", "r.*")


def job_stats(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: jobs in all, with a schedule, whose last run failed, and running now.

    ``jobs`` has ``job, schedule``.
    """
    state = jobs.join(last_status(runs).select("job", "status"), "job", "left")
    return state.agg(
        F.count("*").alias("total"),
        F.count("schedule").alias("scheduled"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "running").alias("running"),
    )


def last_seven(runs: DataFrame) -> DataFrame:
    """``job, bar``: its last seven runs oldest first, ``o`` ok, ``x`` not, ``-`` for none."""
    mark = F.when(F.col("status") == "success", "o").otherwise("x")
    latest = top_per_key(
        runs.select("job", "started_at", "run_id", mark.alias("mark")),
        ["job"],
        [F.desc_nulls_last("started_at"), F.desc("run_id")],
        7,
        "place",
    )
    # Seven entries per job at most.
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("p"), "mark")))
    bar = F.concat_ws("", F.transform(ordered, lambda e: e["mark"]))
    return latest.groupBy("job").agg(F.lpad(bar, 7, "-").alias("bar"))


def day_slots(runs: DataFrame, day: str, slots: int = 7) -> DataFrame:
    """A day's runs cut into equal slots by start, then run_id: ``slot, runs, status``.

    A slot's status is running, else fail, else ok; slots without runs are empty.
    """
    start = F.lit(day).cast("date")
    today = runs.filter(F.to_date("started_at") == start).select("started_at", "run_id", "status")
    numbered = row_numbers(today, ["started_at", "run_id"], "_place")
    total = numbered.agg(F.count("*")).scalar()
    size = F.greatest(F.floor(total / slots), F.lit(1))
    slot = F.least(F.floor(F.col("_place") / size), F.lit(slots - 1))
    severity = (
        F.when(F.col("status") == "running", 2).when(F.col("status") == "failed", 1).otherwise(0)
    )
    filled = (
        numbered.withColumn("slot", slot)
        .groupBy("slot")
        .agg(F.count("*").alias("runs"), F.max(severity).alias("worst"))
    )
    every = runs.sparkSession.range(slots).withColumnRenamed("id", "slot")
    status = (
        F.when(F.col("worst").isNull(), "empty")
        .when(F.col("worst") == 2, "running")
        .when(F.col("worst") == 1, "fail")
        .otherwise("ok")
    )
    return every.join(filled, "slot", "left").select(
        "slot", F.coalesce("runs", F.lit(0)).alias("runs"), status.alias("status")
    )


def dead_letters(runs: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs whose failures since their last success reached the limit: ``job, attempts``.

    The last success of each job is one aggregated row, so no job's history is ordered.
    """
    finished = runs.filter(F.col("status").isin("success", "failed")).withColumn(
        "_at", F.struct("started_at", "run_id")
    )
    success = finished.filter("status = 'success'").groupBy("job").agg(F.max("_at").alias("_ok"))
    failed = finished.filter("status = 'failed'").join(success, "job", "left")
    since = failed.filter(F.col("_ok").isNull() | (F.col("_at") > F.col("_ok")))
    return (
        since.groupBy("job")
        .agg(F.count("*").alias("attempts"), F.max("started_at").alias("last_failed_at"))
        .filter(F.col("attempts") >= max_attempts)
    )


def cost_by_provider(costs: DataFrame, budget: float) -> DataFrame:
    """``provider, spend, share, budget_pct``: share of the total, total against the budget."""
    spent = costs.filter("provider <> '' AND cost_usd <> 0").groupBy("provider").agg(
        F.sum("cost_usd").alias("spend")
    )
    total = spent.agg(F.sum("spend")).scalar()
    pct = F.round(F.least(total / F.lit(budget) * 100, F.lit(100.0)), 1)
    return spent.select(
        "provider",
        F.round("spend", 4).alias("spend"),
        F.round(F.try_divide(F.col("spend"), total), 4).alias("share"),
        pct.alias("budget_pct"),
    )


def trace_stats(traces: DataFrame) -> DataFrame:
    """One row over traces ``status, latency_ms, tool_calls``."""
    errors = F.count_if(F.col("status") == "error")
    return traces.agg(
        F.count("*").alias("total_runs"),
        errors.alias("error_count"),
        F.round(F.coalesce(F.try_divide(errors, F.count("*")), F.lit(0.0)), 6).alias("error_rate"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("avg_latency_ms"),
        F.coalesce(F.sum("tool_calls"), F.lit(0)).alias("total_tool_calls"),
    )


def trace_steps(runs: DataFrame, steps: DataFrame, cuts: Mapping[str, int]) -> DataFrame:
    """Every step beside its run, texts cut to the given lengths, one row per step.

    Steps carry their own number, so a run with very many steps is never gathered.
    """
    cut = {c: F.substring(F.col(c), 1, n) for c, n in cuts.items() if c in steps.columns}
    head = {c: F.substring(F.col(c), 1, n) for c, n in cuts.items() if c in runs.columns}
    return steps.withColumns(cut).join(runs.withColumns(head), "run_id")


def log_filter(logs: DataFrame, least: str, limit: int = 200) -> DataFrame:
    """Newest log rows at or above a level; levels compare by severity, not by name."""
    rank = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return (
        logs.filter(rank[F.upper("level")] >= LEVELS[least.upper()])
        .orderBy(F.desc_nulls_last("logged_at"), F.desc("log_id"))
        .limit(limit)
    )


def health_overlay(runs: DataFrame, recent: int = 20) -> DataFrame:
    """One row: failures among the newest runs, and jobs in the dead-letter list."""
    dead = dead_letters(runs).agg(F.count("*")).scalar()
    return (
        recent_runs(runs, recent)
        .agg(F.count_if(F.col("status") == "failed").alias("recent_failures"))
        .withColumn("dead_jobs", dead)
    )


def alert_rules(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """``rule, subject, detail, severity, state``: one rule per drift score and per job that ended badly.

    ``scores`` comes from the drift operator. A drift rule fires where its score passed the monitor's
    threshold and is quiet otherwise; its severity is the score's band.
    """
    drifting = scores.select(
        F.lit("feature_drift").alias("rule"),
        F.col("feature").alias("subject"),
        F.concat(F.lit("population stability index "), F.col("psi").cast("string")).alias("detail"),
        "severity",
        F.when(F.col("drift_detected"), "firing").otherwise("quiet").alias("state"),
    )
    broken = last_status(runs).filter("status = 'failed'")
    return drifting.unionByName(
        broken.select(
            F.lit("job_broken").alias("rule"),
            F.col("job").alias("subject"),
            F.lit("newest run did not succeed").alias("detail"),
            F.lit("critical").alias("severity"),
            F.lit("firing").alias("state"),
        )
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("state", "severity").agg(F.count("*").alias("n"))
