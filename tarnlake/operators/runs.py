"""Running pipelines: dependency order, one run, all runs, backfill."""

from __future__ import annotations

import functools
import time
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarnlake.config import Pipeline, Project
from tarnlake.operators.incremental import EPOCH, after_watermark, drop_seen
from tarnlake.operators.quality import QualityFailure, check_pipeline, evaluate_rules, rule_from_dict, split_rows
from tarnlake.operators.schema import enforce as enforce_contract
from tarnlake.operators.transforms import apply_steps
from tarnlake.operators.upserts import merge_scd1, merge_scd2
from tarnlake.sources.manifest import Part
from tarnlake.sources.readers import read_source
from tarnlake.sources.tables import STATE, Batch, Lakehouse

RUN_SCHEMA = (
    "pipeline string, status string, rows_in bigint, rows_out bigint, duration_s double, "
    "error string"
)
LINEAGE_SCHEMA = (
    "event_id string, operation string, layer string, source string, destination string, "
    "input_count bigint, output_count bigint, pipeline_name string, parent_id string"
)
DEAD_SCHEMA = "pipeline string, attempts int, error string"
RULE_SCHEMA = "pipeline string, rule string, checked bigint, failed bigint, pass_pct double, passed boolean"
HASH_SCHEMA = "content_hash string, source string"


def run_order(depends_on: Mapping[str, list[str]]) -> list[str]:
    """Names with every dependency first, alphabetical among equals; a cycle is an error.

    Dependencies that name no pipeline are outside tables and are ignored.
    """
    waiting = {n: {d for d in deps if d in depends_on} for n, deps in depends_on.items()}
    done: list[str] = []
    while waiting:
        ready = sorted(n for n, deps in waiting.items() if not deps)
        if not ready:
            raise ValueError(f"dependency cycle among {sorted(waiting)}")
        done += ready
        waiting = {n: deps - set(ready) for n, deps in waiting.items() if n not in ready}
    return done


def roots(depends_on: Mapping[str, list[str]]) -> list[str]:
    return sorted(n for n, deps in depends_on.items() if not any(d in depends_on for d in deps))


def dependents(depends_on: Mapping[str, list[str]], name: str) -> list[str]:
    return sorted(n for n, deps in depends_on.items() if name in deps)


class Runner:
    """Runs a project's pipelines into a lakehouse.

    A run is one batch: rows, quarantined rows, content hashes, watermark, rule results and lineage
    become visible in one step, or not at all. A run that died halfway is simply run again.
    """

    def __init__(self, spark: SparkSession, project: Project, lakehouse: Lakehouse):
        self.spark = spark
        self.project = project
        self.lake = lakehouse

    # --- state tables ---

    def _state(self, name: str, schema: str) -> DataFrame:
        if self.lake.exists(name, STATE):
            return self.lake.read(name, STATE).select(*self.spark.createDataFrame([], schema).columns)
        return self.spark.createDataFrame([], schema)

    def watermarks(self) -> DataFrame:
        rows = [(k, v) for k, v in self.lake.manifest().marks.items() if k in self.project.pipelines]
        marks = self.spark.createDataFrame(rows, "source string, watermark string")
        return marks.withColumn("watermark", F.col("watermark").cast("timestamp"))

    def hashes(self) -> DataFrame:
        held = [self._hashes_of(n) for n in self.project.pipelines if self.lake.exists(f"hashes_{n}", STATE)]
        return functools.reduce(DataFrame.unionByName, held, self.spark.createDataFrame([], HASH_SCHEMA))

    def _hashes_of(self, name: str) -> DataFrame:
        return self._state(f"hashes_{name}", "content_hash string").withColumn("source", F.lit(name))

    def lineage(self) -> DataFrame:
        return self._state("lineage", LINEAGE_SCHEMA)

    def run_log(self) -> DataFrame:
        return self._state("runs", RUN_SCHEMA)

    def dead_letters(self) -> DataFrame:
        return self._state("dead_letters", DEAD_SCHEMA)

    def rule_results(self) -> DataFrame:
        return self._state("rules", RULE_SCHEMA)

    def quarantine(self, name: str) -> DataFrame:
        """Rows that a pipeline's rules or its dimension turned away, with ``broken``."""
        return self.lake.read(f"{name}_quarantine", STATE)

    def reset(self, name: str, clear_hashes: bool = True) -> None:
        with self.lake.batch() as batch:
            self._reset(batch, name, clear_hashes)

    def _reset(self, batch: Batch, name: str, clear_hashes: bool) -> None:
        if clear_hashes:
            batch.marks.pop(name, None)
            batch.drop(self.lake.key(f"hashes_{name}", STATE))
        elif name in batch.marks:
            batch.marks[name] = EPOCH

    # --- one pipeline ---

    def _table(self, name: str) -> DataFrame:
        held = self.lake.find(name)
        if held is None:
            raise LookupError(f"no source or table named {name!r}")
        return held

    def _input(self, name: str) -> DataFrame:
        if name in self.project.sources:
            return read_source(self.spark, self.project.sources[name])
        return self._table(name)

    def run(self, name: str) -> dict:
        """Extract, transform, hold to contract, rules and gate, load, and move the watermark."""
        with self.lake.batch() as batch:
            return self._run(batch, self.project.pipelines[name])

    def _run(self, batch: Batch, pipeline: Pipeline, afresh: bool = False) -> dict:
        self.lake.register_views()
        df = self._input(pipeline.source)
        incremental = pipeline.fetch_mode == "incremental"
        if incremental:
            df = self._unseen(batch, pipeline, df)
        table = self.lake.key(pipeline.target, pipeline.layer or pipeline.target_layer)
        counted = Observation(f"in_{pipeline.name}_{time.time_ns()}")
        df = df.observe(counted, F.count(F.lit(1)).alias("n"))
        # Staged rows are what all checks read, so source and transforms run once.
        if incremental:
            landed = batch.stage(df, self.lake.key(f"landed_{pipeline.name}", STATE))
            df = batch.read_part(landed)
        out = apply_steps(df.drop("content_hash") if incremental else df, pipeline.transforms)
        if pipeline.contract:
            out = enforce_contract(out, pipeline.contract)
        staged = batch.stage(out, table, pipeline.partition_by)
        result = batch.read_part(staged)
        rows_in = counted.get["n"]
        staged, turned_away = self._held_to_rules(batch, pipeline, table, staged, result)
        result = batch.read_part(staged)
        failed = [c for c, _, ok in check_pipeline(result, pipeline.quality) if not ok]
        if failed:
            raise QualityFailure(f"{pipeline.name}: {', '.join(failed)}")
        if afresh:
            batch.drop(table)
        rows_out = self._load(batch, pipeline, table, staged, result, turned_away, incremental)
        if incremental:
            hashes = batch.stage(batch.read_part(landed).select("content_hash"), self.lake.key(f"hashes_{pipeline.name}", STATE))
            batch.add(self.lake.key(f"hashes_{pipeline.name}", STATE), hashes)
            self._advance(batch, pipeline, batch.read_part(landed))
        self._record(batch, pipeline, table, rows_in, rows_out)
        return {"rows_in": rows_in, "rows_out": rows_out}

    def _unseen(self, batch: Batch, pipeline: Pipeline, df: DataFrame) -> DataFrame:
        """Rows after the watermark whose content was not loaded before."""
        column = pipeline.watermark_col
        if dict(df.dtypes)[column] not in ("timestamp", "timestamp_ntz", "date"):
            df = df.withColumn(column, F.col(column).cast("timestamp"))
        # One value, compared in the column's own type, so the scan can skip row groups.
        df = after_watermark(df, column, batch.marks.get(pipeline.name), pipeline.lateness)
        held = batch.entry(self.lake.key(f"hashes_{pipeline.name}", STATE))
        seen = batch.read_part(*held.parts) if held else self.spark.createDataFrame([], "content_hash string")
        return drop_seen(df, seen)

    def _advance(self, batch: Batch, pipeline: Pipeline, rows: DataFrame) -> None:
        text = F.max(pipeline.watermark_col).cast("timestamp_ntz").cast("string")
        reached = rows.agg(text).first()[0]
        held = batch.marks.get(pipeline.name)
        if reached is not None and (held is None or reached > held):
            batch.marks[pipeline.name] = reached

    def _held_to_rules(self, batch: Batch, pipeline: Pipeline, table: str, staged: Part, result: DataFrame) -> tuple[Part, DataFrame | None]:
        """(staged rows that no ``skip`` rule takes out, those taken out); raises on a broken ``fail`` rule."""
        rules = [rule_from_dict(r) for r in pipeline.rules]
        rules = [r for r in rules if r.enabled]
        if not rules:
            return staged, None
        found = evaluate_rules(result, rules, self._table).collect()
        told = [(pipeline.name, *(r[c] for c in ("rule", "checked", "failed", "pass_pct", "passed"))) for r in found]
        key = self.lake.key("rules", STATE)
        broken = {r["rule"] for r in found if not r["passed"]}
        hard = sorted(r.label for r in rules if r.on_failure == "fail" and r.label in broken)
        if hard:
            raise QualityFailure(f"{pipeline.name}: {', '.join(hard)}")
        batch.add(key, batch.stage(self.spark.createDataFrame(told, RULE_SCHEMA), key))
        if not any(r.on_failure == "skip" and r.label in broken for r in rules):
            return staged, None
        kept, taken = split_rows(result, rules, self._table)
        return batch.stage(kept, table, pipeline.partition_by), taken

    def _load(self, batch, pipeline, table, staged, result, turned_away, incremental) -> int:
        if pipeline.scd:
            scd = pipeline.scd
            if scd.kind == 1:
                merge_scd1(batch, table, result, scd.key, scd.ts)
                rejected = None
            else:
                rejected = merge_scd2(batch, table, result, scd.key, scd.ts, scd.tracked)
            rows_out = staged.rows
            if rejected is not None:
                rejected = rejected.withColumn("broken", F.lit("late"))
                turned_away = rejected if turned_away is None else turned_away.unionByName(rejected, allowMissingColumns=True)
        elif incremental:
            batch.add(table, staged)
            rows_out = staged.rows
        else:
            batch.put(table, [staged])
            rows_out = staged.rows
        if turned_away is not None:
            key = self.lake.key(f"{pipeline.name}_quarantine", STATE)
            part = batch.stage(turned_away, key)
            # A full load states all rows anew, its quarantine too.
            if incremental or pipeline.scd:
                batch.add(key, part)
            else:
                batch.put(key, [part])
        return rows_out

    def _record(self, batch: Batch, pipeline: Pipeline, table: str, rows_in: int, rows_out: int) -> None:
        """Lineage of the run: where rows entered, an ``ingest`` event, and the step itself, whose parent wrote its input."""
        rows, parent = [], None
        if pipeline.source in self.project.sources:
            source = self.project.sources[pipeline.source]
            parent = f"{batch.id}-ingest"
            rows.append((parent, "ingest", "bronze", source.path or source.url or source.name, pipeline.source, rows_in, rows_in, pipeline.name, None))
        else:
            parent = next((e.event for k, e in batch.tables.items() if k.split("/", 1)[1] == pipeline.source), None)
        # Gold tables combine; what comes before cleans and shapes.
        operation = "enrich" if table.startswith("gold/") else "transform"
        event = f"{batch.id}-{operation}"
        rows.append((event, operation, table.split("/", 1)[0], pipeline.source, pipeline.target, rows_in, rows_out, pipeline.name, parent))
        batch.tables[table] = replace(batch.tables[table], event=event)
        key = self.lake.key("lineage", STATE)
        batch.add(key, batch.stage(self.spark.createDataFrame(rows, LINEAGE_SCHEMA), key))

    # --- many pipelines ---

    def _tried(self, name: str) -> tuple[dict, str | None, int]:
        """(result, error, attempts) of a pipeline, tried as often as it says."""
        allowed = max(1, self.project.pipelines[name].attempts)
        for attempt in range(1, allowed + 1):
            try:
                return self.run(name), None, attempt
            except Exception as problem:  # noqa: BLE001 - the status row carries the cause
                error = f"{type(problem).__name__}: {problem}"
        return {}, error, allowed

    def run_all(self) -> DataFrame:
        """Every pipeline once, in dependency order; a failure does not stop the others.

        A pipeline that fails as often as it may be tried goes to the dead letters.
        """
        graph = {n: list(p.depends_on) for n, p in self.project.pipelines.items()}
        rows, dead = [], []
        for name in run_order(graph):
            started = time.time()
            done, error, attempts = self._tried(name)
            status = "failed" if error else "success"
            rows.append((name, status, done.get("rows_in"), done.get("rows_out"), time.time() - started, error))
            if error:
                dead.append((name, attempts, error))
        log = self.spark.createDataFrame(rows, RUN_SCHEMA)
        with self.lake.batch() as batch:
            batch.add(self.lake.key("runs", STATE), batch.stage(log, self.lake.key("runs", STATE)))
            if dead:
                key = self.lake.key("dead_letters", STATE)
                batch.add(key, batch.stage(self.spark.createDataFrame(dead, DEAD_SCHEMA), key))
        return log

    def backfill(self, name: str, clear_hashes: bool = True) -> dict:
        """Forget how far the pipeline got and run it again, in one batch.

        With the hashes cleared its table is rebuilt; with them kept only content never
        seen before is added.
        """
        pipeline = self.project.pipelines[name]
        with self.lake.batch() as batch:
            incremental = pipeline.fetch_mode == "incremental"
            if incremental:
                self._reset(batch, name, clear_hashes)
            return self._run(batch, pipeline, afresh=incremental and clear_hashes)
