"""Hard-negative mining by exact inner products, most of them bounded along a spanning tree of anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.llm.common import COPIES, repeated, saved

#: Candidates and anchors (one tree) that meet in one task, and candidates scored at once there.
BLOCK_ROWS, TREE_ROWS, TILE = 65_536, 2_048, 8_192
LONGS = np.iinfo(np.int64)


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, v: rows with an id, a label and a vector whose scaled components are all finite."""
    scaled = F.transform("embedding", lambda x: F.lit(scale) * x.cast("double"))
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    return vectors.where(F.coalesce(kept, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v")
    )


def matrix(column: pa.ChunkedArray, scale: float, dims: int) -> np.ndarray:
    """Rows of floor(scale * x) as whole doubles; shorter vectors are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dims).all():
        out = flat.reshape(-1, dims)
    else:
        out = np.zeros((len(sizes), dims))
        out[np.arange(dims) < sizes[:, None]] = flat
    return np.floor(scale * out)


def spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """(node, parent or -1, edge length) of a minimum spanning tree, parents first.

    Below a node the largest subtree comes last, so a walk in this order holds few open ancestors.
    """
    n = len(points)
    parent, best = np.full(n, -1), np.full(n, np.inf)
    outside = np.ones(n, bool)
    children: list[list[int]] = [[] for _ in range(n)]
    joined, node = [], 0
    for _ in range(n):
        outside[node] = False
        joined.append(node)
        if parent[node] >= 0:
            children[parent[node]].append(node)
        length = np.sqrt(((points - points[node]) ** 2).sum(axis=1))
        closer = outside & (length < best)
        best[closer], parent[closer] = length[closer], node
        node = int(np.argmin(np.where(outside, best, np.inf)))
    weight = np.ones(n, np.int64)
    for node in reversed(joined[1:]):
        weight[parent[node]] += weight[node]
    out, stack = [], [0] if n else []
    while stack:
        node = stack.pop()
        out.append((node, int(parent[node]), float(best[node]) if parent[node] >= 0 else 0.0))
        stack += sorted(children[node], key=lambda c: -weight[c])
    return out


class Candidates:
    """Vectors of a block, and exact inner products with some of them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        self.largest = np.abs(vectors).max(axis=1, initial=0.0)

    def tiles(self, rows: int):
        for k in range(0, len(self.ids), rows):
            yield Candidates(self.ids[k : k + rows], self.labels[k : k + rows], self.vectors[k : k + rows])

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Doubles are exact while every partial sum stays below 2 ** 53; beyond, whole numbers of any size are used."""
        part = self.vectors if len(rows) == len(self.ids) else self.vectors[rows]
        out = part @ anchor
        limit = self.largest[rows] * (np.abs(anchor).max(initial=0.0) * len(anchor))
        if (limit < 2.0**53).all():
            return out.astype(np.int64)
        whole = [int(x) for x in anchor]
        exact = np.zeros(len(rows), np.int64)
        exact[limit < 2.0**53] = out[limit < 2.0**53].astype(np.int64)
        for k in np.flatnonzero(limit >= 2.0**53):
            total = sum(int(x) * y for x, y in zip(part[k], whole, strict=True))
            exact[k] = min(max(total, LONGS.min), LONGS.max)
        return exact


def walk(tree, anchors: np.ndarray, tile: Candidates, wanted):
    """(anchor, rows, scores) down the tree: exact scores of the rows that ``wanted`` picks from their bounds.

    A score differs from the parent anchor's by at most the edge length times the candidate's norm. Rows
    rescored at an anchor have exact bounds for its children; the others' widen along the edges.
    """
    bounds: dict[int, list] = {}
    left = dict.fromkeys(range(len(anchors)), 0)
    for _, parent, _ in tree:
        left[parent] = left.get(parent, 0) + 1
    every = np.arange(len(tile.ids))
    for node, parent, length in tree:
        if parent < 0:
            low, high, rows = None, None, every
        else:
            low, high = bounds[parent]
            slack = (length * tile.norms) * (1 + 1e-9) + 1e-6
            slack += 1e-9 * np.maximum(np.abs(low), np.abs(high))
            low, high = low - slack, high + slack
            left[parent] -= 1
            if not left[parent]:
                del bounds[parent]
            rows = wanted(node, low, high)
        score = tile.scores(anchors[node], rows)
        if left.get(node):
            # Scores past the range of a long are bounded by it alone.
            edge_low = np.where(score == LONGS.min, -np.inf, score)
            edge_high = np.where(score == LONGS.max, np.inf, score)
            if low is None:
                low, high = edge_low, edge_high
            else:
                low[rows], high[rows] = edge_low, edge_high
            bounds[node] = [low, high]
        yield node, rows, score


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _cut(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        held = scores >= kth(scores, k)
        ids, scores = ids[held], scores[held]
    order = np.lexsort((ids, ~scores))[:k]  # the complement turns the order of longs round
    return ids[order], scores[order]


def _best_same(block: Candidates, ids, labels, anchors, k: int, tile_rows: int):
    """(anchor, its k best rows of the same label in this block)."""
    tree = spanning_tree(anchors)
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
    for tile in block.tiles(tile_rows):

        def wanted(node, low, high, tile=tile):
            own = (tile.labels == labels[node]) & (tile.ids != ids[node])
            floor = max(kth(low[own], k), kth(held[node][1].astype(np.float64), k))
            return np.flatnonzero(own & (high >= floor))

        for node, rows, score in walk(tree, anchors, tile, wanted):
            own = (tile.labels[rows] == labels[node]) & (tile.ids[rows] != ids[node])
            held[node] = _cut(np.concatenate([held[node][0], tile.ids[rows[own]]]), np.concatenate([held[node][1], score[own]]), k)
    return enumerate(held)


def _best_in_windows(block: Candidates, ids, labels, anchors, windows, k: int, tile_rows: int):
    """(anchor, window, its k best rows of another label in this block whose score the window holds)."""
    tree = spanning_tree(anchors)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    held = [[empty] * len(w) for w in windows]
    for tile in block.tiles(tile_rows):

        def wanted(node, low, high, tile=tile):
            other = np.flatnonzero((tile.labels != labels[node]) & (tile.ids != ids[node]))
            low, high = low[other], high[other]
            keep = np.zeros(len(other), bool)
            for w, (least, most) in enumerate(windows[node]):
                sure = low[(low >= least) & (high <= most)]
                floor = max(least, kth(sure, k), kth(held[node][w][1].astype(np.float64), k))
                keep |= (high >= floor) & (low <= most)
            return other[keep]

        for node, rows, score in walk(tree, anchors, tile, wanted):
            other = (tile.labels[rows] != labels[node]) & (tile.ids[rows] != ids[node])
            row_ids, score = tile.ids[rows[other]], score[other]
            for w, (least, most) in enumerate(windows[node]):
                fits = (score >= least) & (score <= most)
                if fits.any():
                    held[node][w] = _cut(
                        np.concatenate([held[node][w][0], row_ids[fits]]), np.concatenate([held[node][w][1], score[fits]]), k
                    )
    for node, lists in enumerate(held):
        for w, (found, score) in enumerate(lists):
            yield node, w, found, score


def _pairs(rows: DataFrame, anchors: DataFrame, n_blocks: int, n_trees: int):
    """Blocks of rows and trees of anchors, each pair of them under one key, in partitions of its own."""
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    width = min(n_blocks * n_trees, 10_000)
    left = rows.withColumn("block", spread).withColumn("tree", trees).repartition(width, "block", "tree")
    right = anchors.withColumn("block", blocks).repartition(width, "block", "tree")
    return left.groupBy("block", "tree").cogroup(right.groupBy("block", "tree"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 10, window=(30, 90), scale: float = 256.0,
    tile_rows: int = TILE, copies: int = COPIES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors`` (vec_id, embedding, label).

    Components become floor(scale * x); a score is the whole-number inner product with the anchor, higher
    first, ties by smaller vec_id. ``label`` (over vec_id and label) is the label to go by. An anchor's
    positives are its first rows of the same label; for each, the negatives are the first rows of other
    labels whose score lies between ``window`` percent of the positive's. Rows without an id, a label, a vector or with a null or non-finite (scaled)
    component take no part; an anchor without positives, and so an empty table, gives no rows. Rows of the anchor's own vec_id are
    no candidates for it; other repeated rows each count, and a repeated anchor row gives its rows as often.
    Shorter vectors are padded with zeros; a score beyond 64 bits counts as the nearest long.

    Blocks of candidates meet groups of anchors; each pair keeps a bounded number of rows per anchor. A
    group's anchors form a minimum spanning tree: along an edge a score moves by at most the edge's length
    times the candidate's norm, and only candidates whose bounds reach the sought scores are rescored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, scale).withColumn("label", label.cast("long")).where("label is not null")
    n, n_anchors, dims = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.max(F.size("v"))).first()
    dims = dims or 0
    # Blocks are as large as a task bears; few rows are cut finer, so that every core has some.
    n_blocks = max(1, -(-n // BLOCK_ROWS), min(2 * spark.sparkContext.defaultParallelism, n // 1024))
    n_trees = max(1, -(-n_anchors // TREE_ROWS))
    anchors = rows.where(is_anchor).groupBy("vec_id", "label", "v").agg(F.count("*").alias("times"))
    anchors = saved(anchors.withColumn("a", F.monotonically_increasing_id()), "anchors")
    seats = anchors.withColumn("tree", F.pmod(F.xxhash64("a"), F.lit(n_trees)).cast("int")).drop("times")

    def block_of(table: pa.Table) -> Candidates:
        return Candidates(table["vec_id"].to_numpy(), table["label"].to_numpy(), matrix(table["v"], scale, dims))

    def positives(table: pa.Table, group: pa.Table) -> pa.Table:
        ids, labels = group["vec_id"].to_numpy(), group["label"].to_numpy()
        a, out = group["a"].to_numpy(), []
        if table.num_rows and group.num_rows:
            best_same = _best_same(block_of(table), ids, labels, matrix(group["v"], scale, dims), n_positives, tile_rows)
            out = [(a[k], x, y) for k, held in best_same for x, y in zip(*held, strict=True)]
        return _longs(out, ["a", "id", "score"])

    found = _pairs(rows, seats, n_blocks, n_trees).applyInArrow(positives, "a long, id long, score long")
    best = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_positives)
    found = saved(found, "positives")
    per_anchor = found.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("positives"))
    seats = seats.join(per_anchor, "a")
    low, high = window

    def negatives(table: pa.Table, group: pa.Table) -> pa.Table:
        ids, labels = group["vec_id"].to_numpy(), group["label"].to_numpy()
        a, out = group["a"].to_numpy(), []
        if table.num_rows and group.num_rows:
            lists = group["positives"].to_pylist()
            # Whole-number ends of the windows.
            windows = [[(-(-low * p["score"] // 100), high * p["score"] // 100) for p in of_anchor] for of_anchor in lists]
            of_block = _best_in_windows(block_of(table), ids, labels, matrix(group["v"], scale, dims), windows, n_negatives, tile_rows)
            out = [(a[k], lists[k][w]["place"], x, y) for k, w, rows_, score in of_block for x, y in zip(rows_, score, strict=True)]
        return _longs(out, ["a", "place", "id", "score"])

    mined = _pairs(rows, seats, n_blocks, n_trees).applyInArrow(negatives, "a long, place long, id long, score long")
    best = Window.partitionBy("a", "place").orderBy(F.desc("score"), "id")
    mined = mined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    names = found.select("a", F.col("place").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = mined.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(names, ["a", "place"])
    out = out.join(anchors.select("a", F.col("vec_id").alias("anchor_id"), "times"), "a")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # Which anchors are repeated is known from their own small table.
    once, again = out.where("times = 1").select(*columns), out.where("times > 1").select(*columns, "times")
    if not anchors.where("times > 1").limit(1).count():
        return once
    return once.unionByName(repeated(again, "times", copies))


def _longs(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = np.array(rows, np.int64).reshape(-1, len(names))
    return pa.table({name: pa.array(columns[:, k]) for k, name in enumerate(names)})
