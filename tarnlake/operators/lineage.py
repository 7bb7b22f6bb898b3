"""Lineage event tables: edges, nodes, summaries. Walks are in ``graph``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_edges(events: DataFrame) -> DataFrame:
    """Distinct ``source, destination, pipeline_name`` with both ends known."""
    return (
        events.filter("source IS NOT NULL AND destination IS NOT NULL")
        .select("source", "destination", "pipeline_name")
        .distinct()
    )


def node_pipelines(edges: DataFrame) -> DataFrame:
    """Per node the pipelines that touch it: ``node, pipeline_name`` rows, each once."""
    ends = F.explode(F.array("source", "destination")).alias("node")
    return edges.select(ends, "pipeline_name").distinct()


def config_edges(pipelines: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges of a pipeline table whose two ends are sources or pipeline outputs.

    ``pipelines`` has ``source, destination``; ``sources`` has ``name``.
    """
    known = (
        sources.select("name")
        .unionByName(pipelines.select(F.col("destination").alias("name")))
        .filter("name IS NOT NULL")
        .distinct()
    )
    return (
        pipelines.select("source", "destination")
        .distinct()
        .join(known, F.col("source") == F.col("name"), "left_semi")
        .filter("destination IS NOT NULL")
    )


def summary(events: DataFrame) -> DataFrame:
    """Events and rows by layer and operation."""
    return events.groupBy("layer", "operation").agg(
        F.count("*").alias("events"),
        F.sum("input_count").alias("rows_in"),
        F.sum("output_count").alias("rows_out"),
    )
