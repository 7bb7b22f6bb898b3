"""Quality measures, rules, tests and gates, evaluated in as few scans as possible."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.config import Quality

LAYER_THRESHOLDS = {"bronze": 0.5, "silver": 0.75, "gold": 0.9}


# --- measures -------------------------------------------------------------------


def completeness(columns: Sequence[str]) -> Column:
    """Mean over the columns of their not-null share; null on an empty table."""
    shares = [F.try_divide(F.count(c), F.count(F.lit(1))) for c in columns]
    return functools.reduce(lambda a, b: a + b, shares) / len(shares)


def unique_share(column: str) -> Column:
    """Distinct over not-null values; an all-null column counts as unique."""
    return F.coalesce(F.try_divide(F.count_distinct(column), F.count(column)), F.lit(1.0))


def uniqueness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column ``(column_name, distinct_values, checked, share, passed)``.

    Columns are unpivoted and counted per value first: a value that fills a third of the
    table shrinks to one row per partition before it is shuffled, and all columns share
    one scan.
    """
    typed = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
             for c in columns]
    per_value = (
        df.select(F.explode(F.array(*typed)).alias("e"))
        .select("e.*")
        .groupBy("column_name", "v")
        .agg(F.count("*").alias("n"))
    )
    checked = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0))
    distinct = F.count("v")
    share = F.coalesce(F.try_divide(distinct, checked), F.lit(1.0))
    return per_value.groupBy("column_name").agg(
        distinct.alias("distinct_values"),
        checked.alias("checked"),
        share.alias("share"),
        (share >= 1.0).alias("passed"),
    )


def measure(df: DataFrame, columns: Sequence[str], unique: Sequence[str] = ()) -> DataFrame:
    """One row: ``row_count, completeness, uniqueness, score``."""
    dims = [F.col("completeness")] + ([F.col("uniqueness")] if unique else [])
    score = functools.reduce(lambda a, b: a + b, dims) / len(dims)
    out = df.agg(F.count(F.lit(1)).alias("row_count"), completeness(columns).alias("completeness"))
    if unique:
        found = uniqueness(df, unique).agg(F.avg("share").alias("u"))
        out = out.withColumn("uniqueness", F.coalesce(found.scalar(), F.lit(1.0)))
    else:
        out = out.withColumn("uniqueness", F.lit(None).cast("double"))
    return out.withColumn("score", score)


# --- rules ----------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """One row rule: kind, column, settings, and what a failure does."""

    kind: str
    column: str | None = None
    config: Mapping[str, Any] = field(default_factory=dict)
    on_failure: str = "warn"
    enabled: bool = True

    @property
    def label(self) -> str:
        return f"{self.kind}:{self.column or 'row'}"


def bad_row(rule: Rule) -> Column:
    """True where the row breaks the rule. Nulls pass every rule but NULL."""
    c, cfg = rule.column, rule.config
    if rule.kind == "EXPR":
        return F.coalesce(~F.expr(cfg["expr"]), F.lit(False))
    value = F.col(c)
    if rule.kind == "NULL":
        return value.isNull()
    if rule.kind == "TYPE":
        bad = value.cast("string").try_cast(cfg["type"]).isNull()
    elif rule.kind == "RANGE":
        bad = F.lit(False)
        if cfg.get("min") is not None:
            bad = bad | (value < F.lit(cfg["min"]))
        if cfg.get("max") is not None:
            bad = bad | (value > F.lit(cfg["max"]))
    elif rule.kind == "ENUM":
        bad = ~value.isin(list(cfg["allowed"]))
    elif rule.kind == "PATTERN":
        bad = ~value.cast("string").rlike(cfg["pattern"])
    else:
        raise ValueError(f"{rule.kind} is not a row rule")
    return value.isNotNull() & bad


def _checked(rule: Rule) -> Column:
    if rule.kind in ("NULL", "EXPR"):
        return F.count(F.lit(1))
    return F.count(rule.column)


def _result(label: Column, checked: Column, failed: Column) -> list[Column]:
    share = F.coalesce(1 - F.try_divide(failed, checked), F.lit(1.0))
    return [
        label.alias("rule"),
        checked.alias("checked"),
        failed.alias("failed"),
        F.round(share, 6).alias("pass_pct"),
        (failed == 0).alias("passed"),
    ]


def rule_from_dict(raw: Mapping[str, Any]) -> Rule:
    """A rule as a project file states it: ``type``, ``column``, ``on_failure``, ``enabled``; the rest are settings."""
    own = {"type", "column", "on_failure", "enabled"}
    config = {k: v for k, v in raw.items() if k not in own}
    return Rule(raw["type"].upper(), raw.get("column"), config, raw.get("on_failure", "warn"), raw.get("enabled", True))


def _no_tables(name: str) -> DataFrame:
    raise LookupError(f"no table {name!r} to look references up in")


def evaluate_rules(df: DataFrame, rules: Sequence[Rule], tables: Callable[[str], DataFrame] = _no_tables) -> DataFrame:
    """One row per enabled rule: ``rule, checked, failed, pass_pct, passed``.

    All row rules become aggregates of a single scan. UNIQUE rules share one more, every FK rule
    counts its values and meets the table that ``tables`` gives for ``ref_table``.
    """
    active = [r for r in rules if r.enabled]
    row_rules = [r for r in active if r.kind not in ("UNIQUE", "FK")]
    parts = []
    if row_rules:
        wide = df.agg(
            *[_checked(r).alias(f"c{i}") for i, r in enumerate(row_rules)],
            *[F.count_if(bad_row(r)).alias(f"f{i}") for i, r in enumerate(row_rules)],
        )
        rows = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(r.label).alias("rule"),
                        F.col(f"c{i}").alias("checked"),
                        F.col(f"f{i}").alias("failed"),
                    )
                    for i, r in enumerate(row_rules)
                ]
            )
        )
        long = wide.select(rows.alias("r")).select("r.*")
        parts.append(long.select(*_result(F.col("rule"), F.col("checked"), F.col("failed"))))
    unique = [r for r in active if r.kind == "UNIQUE"]
    if unique:
        parts.append(_unique_rules(df, unique))
    for r in active:
        if r.kind == "FK":
            parts.append(foreign_key_rule(df, r.column, tables(r.config["ref_table"]), r.config["ref_col"]))
    if not parts:
        raise ValueError("no enabled rule")
    return functools.reduce(DataFrame.unionByName, parts)


def _unique_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows whose value occurs more than once, per column."""
    typed = [F.struct(F.lit(r.label).alias("rule"), F.col(r.column).cast("string").alias("v"))
             for r in rules]
    values = (
        df.select(F.explode(F.array(*typed)).alias("e"))
        .select("e.*")
        .filter("v IS NOT NULL")
        .groupBy("rule", "v")
        .agg(F.count("*").alias("n"))
        .groupBy("rule")
        .agg(
            F.sum("n").alias("checked"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("failed"),
        )
    )
    names = df.sparkSession.createDataFrame([(r.label,) for r in rules], "rule string")
    full = names.join(values, "rule", "left").na.fill(0, ["checked", "failed"])
    return full.select(*_result(F.col("rule"), F.col("checked"), F.col("failed")))


def foreign_key_rule(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """One result row: not-null values of ``column`` that the reference column lacks."""
    keys = ref.select(F.col(ref_column).alias("_ref")).filter("_ref IS NOT NULL").distinct()
    # Values are counted before the join, so a hot value meets the reference once.
    values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    hits = values.join(keys, F.col(column) == F.col("_ref"), "left")
    totals = hits.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(F.col("_ref").isNull(), F.col("n"))), F.lit(0)).alias("failed"),
    )
    return totals.select(*_result(F.lit(f"FK:{column}"), F.col("checked"), F.col("failed")))


class QualityFailure(RuntimeError):
    """A rule or gate that must hold before a write did not."""


def _bad_values(df: DataFrame, rule: Rule, tables: Callable[[str], DataFrame]) -> DataFrame:
    """The values of a rule's column that break it: repeated ones, or ones without a reference."""
    values = df.filter(F.col(rule.column).isNotNull()).groupBy(F.col(rule.column).alias("value")).agg(F.count("*").alias("n"))
    if rule.kind == "UNIQUE":
        return values.filter("n > 1").select("value")
    keys = tables(rule.config["ref_table"]).select(F.col(rule.config["ref_col"]).alias("value"))
    return values.join(keys, "value", "left_anti").select("value")


def mark_rows(df: DataFrame, rules: Sequence[Rule], tables: Callable[[str], DataFrame] = _no_tables) -> DataFrame:
    """``df`` with ``broken``: the labels of the rules that each row breaks, set apart by commas.

    A rule over more than the row first finds its bad values, once each; rows then look theirs up.
    """
    flags = {}
    marked = df
    for r in rules:
        if r.kind in ("UNIQUE", "FK"):
            flag = f"bad_{uuid.uuid4().hex}"
            bad = _bad_values(df, r, tables).select(F.col("value").alias(f"{flag}_v"), F.lit(True).alias(flag))
            marked = marked.join(bad, F.col(r.column) == F.col(f"{flag}_v"), "left").drop(f"{flag}_v")
            flags[flag] = F.col(flag)
        else:
            flags[len(flags)] = bad_row(r)
    labels = [F.when(test, F.lit(r.label)) for r, test in zip(rules, flags.values(), strict=True)]
    return marked.withColumn("broken", F.concat_ws(",", *labels)).drop(*[f for f in flags if isinstance(f, str)])


def split_rows(df: DataFrame, rules: Sequence[Rule], tables: Callable[[str], DataFrame] = _no_tables) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, quarantined rows with the list of broken rules).

    Rules with ``on_failure=skip`` take rows out; ``warn`` rules only report.
    """
    skip = [r for r in rules if r.enabled and r.on_failure == "skip"]
    if not skip:
        return df, df.limit(0).withColumn("broken", F.lit(""))
    marked = mark_rows(df, skip, tables)
    return marked.filter("broken = ''").drop("broken"), marked.filter("broken <> ''")


def refuse_broken(df: DataFrame, rules: Sequence[Rule], tables: Callable[[str], DataFrame] = _no_tables) -> None:
    """Raise when a rule with ``on_failure=fail`` is broken."""
    hard = [r for r in rules if r.enabled and r.on_failure == "fail"]
    if hard:
        broken = evaluate_rules(df, hard, tables).filter("NOT passed").select("rule").collect()
        if broken:
            raise QualityFailure(", ".join(sorted(r["rule"] for r in broken)))


def enforce(df: DataFrame, rules: Sequence[Rule], tables: Callable[[str], DataFrame] = _no_tables) -> DataFrame:
    """Rows to write; raises before the write when a ``fail`` rule is broken."""
    refuse_broken(df, rules, tables)
    return split_rows(df, rules, tables)[0]


# --- table tests ----------------------------------------------------------------


@dataclass(frozen=True)
class TableTest:
    """``not_null, unique, range, freshness, row_count`` with a text threshold."""

    kind: str
    column: str | None = None
    threshold: str = ""


def run_table_tests(df: DataFrame, tests: Sequence[TableTest], now: Column) -> DataFrame:
    """``test, observed, passed``: freshness is in seconds, range counts rows outside."""
    parts = []
    plain: list[tuple[str, Column, Column]] = []
    for t in tests:
        label = f"{t.kind}:{t.column or 'table'}"
        if t.kind == "not_null":
            n = F.count_if(F.col(t.column).isNull()).cast("double")
            plain.append((label, n, n == 0))
        elif t.kind == "range":
            low, high = (float(x) for x in t.threshold.split(","))
            n = F.count_if(~F.col(t.column).between(low, high)).cast("double")
            plain.append((label, n, n == 0))
        elif t.kind == "row_count":
            n = F.count(F.lit(1)).cast("double")
            plain.append((label, n, n >= float(t.threshold)))
        elif t.kind == "freshness":
            age = (
                F.unix_micros(now.cast("timestamp"))
                - F.unix_micros(F.max(t.column).cast("timestamp"))
            ) / 1e6
            plain.append((label, age, F.coalesce(age <= float(t.threshold), F.lit(False))))
        elif t.kind == "unique":
            rule = Rule("UNIQUE", t.column)
            parts.append(
                _unique_rules(df, [rule]).select(
                    F.lit(label).alias("test"), F.col("failed").cast("double").alias("observed"),
                    "passed",
                )
            )
        else:
            raise ValueError(f"unknown test {t.kind!r}")
    if plain:
        wide = df.agg(
            *[v.alias(f"o{i}") for i, (_, v, _) in enumerate(plain)],
            *[p.alias(f"p{i}") for i, (_, _, p) in enumerate(plain)],
        )
        rows = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(label).alias("test"),
                        F.col(f"o{i}").alias("observed"),
                        F.col(f"p{i}").alias("passed"),
                    )
                    for i, (label, _, _) in enumerate(plain)
                ]
            )
        )
        parts.append(wide.select(rows.alias("r")).select("r.*"))
    return functools.reduce(DataFrame.unionByName, parts)


# --- gates ----------------------------------------------------------------------


def gate(
    df: DataFrame,
    required: Sequence[str],
    unique_key: str | None,
    scorer: Column | None,
    layer: str,
    threshold: float | None = None,
) -> DataFrame:
    """One row ``layer, row_count, completeness, uniqueness, validity, score, passed``.

    ``scorer`` gives each row a value in 0..1. The score is the mean of the dimensions
    present and must reach the layer's threshold.
    """
    limit = LAYER_THRESHOLDS[layer] if threshold is None else threshold
    aggregates = [F.count(F.lit(1)).alias("row_count"), completeness(required).alias("completeness")]
    dims = ["completeness"]
    if unique_key:
        aggregates.append(unique_share(unique_key).alias("uniqueness"))
        dims.append("uniqueness")
    if scorer is not None:
        aggregates.append(F.avg(scorer).alias("validity"))
        dims.append("validity")
    score = functools.reduce(lambda a, b: a + b, [F.col(d) for d in dims]) / len(dims)
    return (
        df.agg(*aggregates)
        .withColumn("score", score)
        .withColumn("layer", F.lit(layer))
        .withColumn("passed", F.coalesce(F.col("score") >= limit, F.lit(False)))
    )


def custom_check(df: DataFrame, sql: str) -> DataFrame:
    """One boolean, ``passed``, from a SELECT over ``_data``."""
    from tarnlake.operators.transforms import sql_step

    out = sql_step(df, sql)
    return out.select(F.coalesce(F.col(f"`{out.columns[0]}`"), F.lit(False)).alias("passed"))


def check_pipeline(df: DataFrame, quality: Quality) -> list[tuple[str, float | None, bool]]:
    """``(check, observed, passed)`` for each configured check of a pipeline."""
    results: list[tuple[str, float | None, bool]] = []
    wanted = [completeness(df.columns).alias("c"), F.count(F.lit(1)).alias("n")]
    if quality.completeness is not None or quality.row_count_min is not None:
        row = df.agg(*wanted).first()
        if quality.completeness is not None:
            ok = row["c"] is not None and row["c"] >= quality.completeness
            results.append(("completeness", row["c"], ok))
        if quality.row_count_min is not None:
            results.append(("row_count", float(row["n"]), row["n"] >= quality.row_count_min))
    if quality.uniqueness:
        # One row per configured column.
        for r in uniqueness(df, quality.uniqueness).collect():
            results.append((f"uniqueness:{r['column_name']}", r["share"], r["passed"]))
    if quality.custom_sql:
        results.append(("custom_sql", None, bool(custom_check(df, quality.custom_sql).first()[0])))
    return results


def check_tables(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], threshold: float):
    """Per table ``table_name, row_count, completeness, uniqueness, score, passed``.

    ``tables`` maps a name to the table and its key columns.
    """
    parts = [
        measure(df, df.columns, keys).select(
            F.lit(name).alias("table_name"),
            "*",
            F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("passed"),
        )
        for name, (df, keys) in tables.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)
