"""Session defaults and the shared scratch area."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # Stored timestamps carry no zone and mean UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows hold whole texts: a batch of many would be large on both sides of the pipe.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "tarnlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def _shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    held = getattr(spark.sparkContext, "_tarnlake_scratch", None)
    if held is None:
        held = tempfile.mkdtemp(prefix="tarnlake-")
        spark.sparkContext._tarnlake_scratch = held
    return held


def shared_path(spark: SparkSession, name: str) -> str:
    """A named path in the folder the cluster names, the same at every call."""
    return f"{_shared_root(spark)}/{name}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for intermediate tables, in the folder the cluster names."""
    return f"{_shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(df):
    """Cut lineage through the shared checkpoint folder, so a lost executor costs no replay."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{_shared_root(spark)}/checkpoints")
    return df.checkpoint(eager=True)
