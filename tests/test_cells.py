"""The cell index against exact search: recall, compared pairs, files opened, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import cells
from tarnlake.operators.cells import CellIndex
from tarnlake.operators.vectors import nearest_neighbours
from tarnlake.session import scratch_path
from tarnlake.sources.tables import Lakehouse

SCHEMA = "id bigint, v array<float>"


def index_over(spark, items, **options):
    index = CellIndex(Lakehouse(spark, scratch_path(spark, "cells")), "t", **options)
    index.build(items, "id", "v", k=5)
    return index


def grouped(spark, groups=25, each=40, dims=16):
    draw = np.random.default_rng(7)
    centres = draw.standard_normal((groups, dims)) * 5
    points = (centres[:, None, :] + draw.standard_normal((groups, each, dims))).reshape(-1, dims)
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], SCHEMA).repartition(4)


def pairs(df):
    return {(r["query_id"], r["item_id"]) for r in df.collect()}


def test_recall_with_far_fewer_pairs(spark):
    items = grouped(spark)
    index = index_over(spark, items, block_rows=32)  # cells of several blocks
    true = pairs(nearest_neighbours(items, items, "id", "v", k=5))
    found = index.search(items, "id", "v", k=5).collect()
    got = {(r["query_id"], r["item_id"]) for r in found}
    assert len(got) == len(found) == 5 * 1000
    assert len(got & true) >= 0.9 * len(true)
    assert index.compared(items, "id", "v") < 0.25 * 1000 * 999


def test_scores_and_ranks_are_exact_where_found(spark):
    items = grouped(spark, groups=6)
    got = {(r["query_id"], r["item_id"]): r["score"] for r in index_over(spark, items).search(items, "id", "v", k=5).collect()}
    true = {(r["query_id"], r["item_id"]): r["score"] for r in nearest_neighbours(items, items, "id", "v", k=5).collect()}
    assert all(got[p] == true[p] for p in got.keys() & true.keys())


def test_a_query_opens_only_its_buckets(spark):
    items = grouped(spark, groups=30, each=50)
    index = index_over(spark, items, bucket_rows=150)
    one = items.where("id = 17")
    opened = index._stored(index.probed(one, "id", "v")).inputFiles()
    assert 0 < len(opened) < len(index._stored().inputFiles())
    assert pairs(index.search(one, "id", "v", k=5)) <= {(17, i) for i in range(1500)}


def test_small_cells_fall_back_to_exact(spark):
    items = grouped(spark, groups=8, each=6)
    got = pairs(index_over(spark, items).search(items, "id", "v", k=30))
    assert got == pairs(nearest_neighbours(items, items, "id", "v", k=30))


def test_a_search_copies_no_query_per_cell(spark):
    items = grouped(spark)
    index = index_over(spark, items, block_rows=64)
    _, probes, _ = index.centres()
    centres = index.centres()[0]
    marked = cells._marked(index._plain(items, "id", "v", 16), centres, probes)
    assert marked.count() == 1000
    wanted = {r["cell"]: r["n"] for r in cells._wanted(index._plain(items, "id", "v", 16), centres, probes).collect()}
    opened = {r["cell"]: r["n"] for r in index.probed(items, "id", "v").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert wanted == opened
    # Only pairs of a query and a row of one of its cells.
    homes = {r["id"]: r["cell"] for r in index._stored().collect()}
    own = {(r["id"], r["cell"]) for r in index.probed(items, "id", "v").collect()}
    assert all((q, homes[i]) in own for q, i in pairs(index.search(items, "id", "v", k=5)))


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(spark, n):
    items = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(n)], SCHEMA)
    assert index_over(spark, items).search(items, "id", "v", k=5).count() == 0


def test_odd_vectors_take_no_part(spark):
    good = [(i, [float(i), 1.0]) for i in range(6)]
    bad = [(10, None), (11, []), (12, [1.0]), (13, [float("nan"), 1.0]), (14, [float("inf"), 1.0]), (15, [None, 1.0])]
    items = spark.createDataFrame(good + bad, SCHEMA)
    found = index_over(spark, items).search(items.where("id < 6"), "id", "v", k=5)
    assert {r["item_id"] for r in found.collect()} == set(range(6))
