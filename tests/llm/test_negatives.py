"""Hard negatives against all inner products in whole numbers, and the bounds they are found by."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, a long, block string, tree int"
LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def mined(df, **more):
    out = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.expr(LABEL), **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def by_hand(rows):
    kept = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = math.fmod(label + 1, 10) if vec_id % 7 == 0 else label
        kept.append((vec_id, int(label), [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for vec_id, label, v in kept:
        if vec_id % 100:
            continue
        limit = lambda x: max(-(2**63), min(2**63 - 1, x))
        others = [(-limit(sum(x * y for x, y in zip(v, w, strict=False))), i, own) for i, own, w in kept if i != vec_id]
        others.sort()
        for s, i, _ in [o for o in others if o[2] == label][:5]:
            fits = [o for o in others if o[2] != label and 30 * -s <= 100 * -o[0] <= 90 * -s]
            out += [(vec_id, i, rank, j, -s, -t) for rank, (t, j, _) in enumerate(fits[:10], 1)]
    return sorted(out)


def vectors(n, dims=8, clusters=6, seed=1):
    dice = random.Random(seed)
    centres = [[dice.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(k, [float(np.float32(x + dice.gauss(0, 0.15))) for x in dice.choice(centres)], dice.randrange(10), 1, "b", 2) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_anchors(spark, partitions, monkeypatch, seed):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 300)
    monkeypatch.setattr(negatives, "TREE_ROWS", 5)
    rows = vectors(1200, seed=seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = by_hand(rows)
    assert len(want) > 100
    for _ in partitions():
        assert mined(df, tile_rows=64) == want


def test_odd_rows(spark):
    rows = vectors(700)
    rows += [(None, [1.0] * 8, 1, 1, "", 1), (5000, None, 1, 1, "", 1), (5100, [1.0] * 8, None, 1, "", 1), (5200, [None] + [1.0] * 7, 1, 1, "", 1)]
    rows += [(5300, [math.nan] + [1.0] * 7, 1, 1, "", 1), (5400, [math.inf] * 8, 1, 1, "", 1), (-100, [0.5] * 8, -3, 1, "", 1)]
    rows += [(6000, [], 2, 1, "", 1), (6001, [0.25], 2, 1, "", 1), (6100, [0.0] * 8, 2, 1, "", 1)]
    rows += [rows[100]] * 3 + [rows[11]] * 7 + [rows[200]] + [(300, rows[7][1], 4, 1, "", 1)]  # repeated ids and rows, ties
    rows += [(7000, [20_000.0] * 8, 1, 1, "", 1), (7001, [20_000.0, -3.5] * 4, 3, 1, "", 1), (7002, [15_000.0] * 8, 3, 1, "", 1), (7003, [19_000.0] * 8, 1, 1, "", 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_scores_beyond_a_long(spark):
    rows = [(k * 50, [1e18 * (k + 1)] * 4, k % 3, 1, "", 1) for k in range(12)]
    rows += [(k * 50 + 1, [1e-2 * (k + 1), -1e-3] * 2, k % 3, 1, "", 1) for k in range(12)]
    rows += [(1500, [1.0] * 4, 0, 1, "", 1), (1600, [-1e30] * 4, 1, 1, "", 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_small_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame(vectors(1), SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1, 1, "", 1)], SCHEMA)) == []


def test_repeated_anchor_rows_are_copied(spark):
    rows = [(100, [1.0, 0.0], 1, 1, "", 1)] * 11 + [(1, [1.0, 0.1], 1, 1, "", 1), (2, [0.5, 0.5], 2, 1, "", 1), (2, [0.5, 0.5], 2, 1, "", 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA), copies=4) == by_hand(rows)
    assert len(by_hand(rows)) == 22


def test_tree_is_least_and_its_bounds_hold():
    dice = np.random.default_rng(3)
    points = np.floor(dice.normal(0, 60, (90, 16)))
    tree = negatives.spanning_tree(points)
    assert sorted(n for n, _, _ in tree) == list(range(90)) and [p for _, p, _ in tree].count(-1) == 1
    place = {n: k for k, (n, _, _) in enumerate(tree)}
    assert all(p < 0 or place[p] < place[n] for n, p, _ in tree)
    length = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    groups, total = {k: k for k in range(90)}, 0.0  # Kruskal
    for i, j in sorted(((i, j) for i in range(90) for j in range(i)), key=lambda e: length[e]):
        if groups[i] != groups[j]:
            total += length[i, j]
            old = groups[i]
            groups = {k: groups[j] if g == old else g for k, g in groups.items()}
    assert sum(d for _, _, d in tree) == pytest.approx(total)
    block = negatives.Candidates(np.arange(500), np.zeros(500, int), np.floor(dice.normal(0, 60, (500, 16))))
    exact = block.vectors @ points.T
    seen = 0

    def wanted(node, low, high):
        nonlocal seen
        assert (low <= exact[:, node]).all() and (exact[:, node] <= high).all()
        seen += 1
        return np.flatnonzero(dice.random(500) < 0.3)

    for node, rows, score in negatives.walk(tree, points, block, wanted):
        assert (score == exact[rows, node]).all()
    assert seen == 89


def test_near_anchors_spare_most_products():
    dice = np.random.default_rng(5)
    centre = dice.normal(0, 1, 32)
    anchors = np.floor(256 * (centre + dice.normal(0, 0.002, (40, 32))))
    block = negatives.Candidates(np.arange(4000) + 1000, np.arange(4000) % 10, np.floor(256 * dice.normal(0, 1, (4000, 32))))
    rescored = 0
    best = max(block.scores(anchors[0], np.arange(4000)))
    windows = [[(int(0.8 * best), int(0.9 * best))]] * 40
    scores = negatives.Candidates.scores

    def counted(self, anchor, rows):
        nonlocal rescored
        rescored += len(rows)
        return scores(self, anchor, rows)

    negatives.Candidates.scores = counted
    try:
        got = list(negatives._best_in_windows(block, np.arange(40), np.full(40, 3), anchors, windows, 10, 8192))
    finally:
        negatives.Candidates.scores = scores
    assert rescored < 0.3 * 40 * 4000 and any(len(ids) for _, _, ids, _ in got)
