"""Lineage and dependency graphs held as edge tables ``(parent, child)``.

Each round is one join on tables that are checkpointed to the shared folder, so plans
stay short and a lost executor costs no replay of earlier rounds.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.session import reliable_checkpoint


def longest_depth(edges: DataFrame) -> DataFrame:
    """``(node, depth)``: the longest path from a root. A cycle is an error.

    Nodes are taken off level by level: a node leaves once all its parents have left.
    """
    edges = reliable_checkpoint(edges.distinct())
    nodes = (
        edges.select(F.col("parent").alias("node"))
        .unionByName(edges.select(F.col("child").alias("node")))
        .distinct()
    )
    waiting = reliable_checkpoint(nodes)
    levels = None
    for depth in itertools.count():
        blocked = edges.select(F.col("child").alias("node")).distinct()
        ready = reliable_checkpoint(waiting.join(blocked, "node", "left_anti"))
        if ready.isEmpty():
            if waiting.isEmpty():
                break
            raise ValueError("dependency cycle")
        level = ready.withColumn("depth", F.lit(depth).cast("bigint"))
        levels = level if levels is None else levels.unionByName(level)
        waiting = reliable_checkpoint(waiting.join(ready, "node", "left_anti"))
        parents = ready.withColumnRenamed("node", "parent")
        edges = reliable_checkpoint(edges.join(parents, "parent", "left_anti"))
    if levels is None:
        return nodes.withColumn("depth", F.lit(0).cast("bigint"))
    return levels


def reachable(edges: DataFrame, starts: DataFrame, direction: str) -> DataFrame:
    """``(start, node, distance)`` of everything downstream or upstream of each start.

    ``starts`` has a ``node`` column. The frontier holds only nodes not reached before,
    so cycles end and no node is expanded twice per start.
    """
    near, far = ("parent", "child") if direction == "downstream" else ("child", "parent")
    hops = reliable_checkpoint(
        edges.select(F.col(near).alias("node"), F.col(far).alias("_to")).distinct()
    )
    frontier = starts.select(F.col("node").alias("start"), "node").distinct()
    seen = reliable_checkpoint(frontier.withColumn("distance", F.lit(0).cast("bigint")))
    frontier = seen
    found = None
    for distance in itertools.count(1):
        step = (
            frontier.join(hops, "node")
            .select("start", F.col("_to").alias("node"))
            .distinct()
            .join(seen.select("start", "node"), ["start", "node"], "left_anti")
            .withColumn("distance", F.lit(distance).cast("bigint"))
        )
        frontier = reliable_checkpoint(step)
        if frontier.isEmpty():
            break
        found = frontier if found is None else found.unionByName(frontier)
        seen = seen.unionByName(frontier)
    return seen.limit(0) if found is None else found


def ancestor_chain(events: DataFrame, node: str, parent: str, starts: DataFrame) -> DataFrame:
    """``(start, node, distance)``: each start followed by its parents up to the root.

    Every event has at most one parent. Jump pointers double in length each round, so a
    chain of a million events takes twenty rounds, and every round is a plain join.
    """
    jumps = reliable_checkpoint(
        events.filter(F.col(parent).isNotNull()).select(
            F.col(node).alias("node"), F.col(parent).alias("up")
        )
    )
    reached = reliable_checkpoint(
        starts.select(
            F.col("node").alias("start"), "node", F.lit(0).cast("bigint").alias("distance")
        )
    )
    length = 1
    while not jumps.isEmpty():
        if length > 2**40:
            raise ValueError("parent links form a cycle")
        further = reached.join(jumps, "node").select(
            "start", F.col("up").alias("node"), (F.col("distance") + length).alias("distance")
        )
        reached = reliable_checkpoint(reached.unionByName(further))
        ahead = jumps.select(F.col("node").alias("up"), F.col("up").alias("_far"))
        jumps = reliable_checkpoint(
            jumps.join(ahead, "up").select("node", F.col("_far").alias("up"))
        )
        length *= 2
    return reached
