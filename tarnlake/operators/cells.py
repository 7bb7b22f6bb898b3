"""Nearest-neighbour index of cells around centres: a search opens only the cells near its queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.ordered import top_per_key
from tarnlake.operators.vectors import SLICE, TINY, meet, nearest_neighbours, packed
from tarnlake.session import reliable_checkpoint
from tarnlake.sources.tables import STATE, Lakehouse

#: Rows that the centres are fitted on at most, and queries that the search depth is measured with at most.
SAMPLE_ROWS = 50_000
TRIAL_QUERIES = 200
#: Centres at most; beyond, cells grow and are cut into blocks.
MAX_CELLS = 2_048
#: Rows that share a folder, by cell, and folders at most.
BUCKET_ROWS, MAX_BUCKETS = 100_000, 256
#: Above this share of the cells a search compares everything instead.
EXACT_ABOVE = 0.8
KEY = ["id", "v", "cell"]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + TINY)


def _fit(points: np.ndarray, n_cells: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Unit centres by k-means on directions; a centre without points keeps its place."""
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), min(n_cells, len(points)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        full = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(full[:, None], _unit(sums), centres)
    return centres


def _nearest_cells(df: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Every row ``id, v`` once per each of its ``probes`` nearest cells, nearest first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            order = _order(frame, centres, probes)
            for place in range(order.shape[1]):
                yield frame.assign(cell=order[:, place], place=place)

    return df.mapInPandas(run, "id bigint, v array<float>, cell int, place int")


def _order(frame: pd.DataFrame, centres: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest cells of every row, nearest first."""
    near = _unit(np.stack(frame["v"].to_numpy()).astype(np.float64)) @ centres.T
    return np.argsort(-near, axis=1, kind="stable")[:, :probes]


def _wanted(df: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``cell, n``: how many rows have a cell among their ``probes`` nearest ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(centres), np.int64)
        for frame in frames:
            if not frame.empty:
                total += np.bincount(_order(frame, centres, probes).ravel(), minlength=len(centres))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"cell": used, "n": total[used]})

    return df.mapInPandas(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def _marked(df: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Every row once, with its nearest cell and a bit in ``mark`` for each of its ``probes`` nearest ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            order = _order(frame, centres, probes)
            bits = np.zeros((len(frame), len(centres)), bool)
            np.put_along_axis(bits, order, True, axis=1)
            yield frame.assign(cell=order[:, 0], mark=[b.tobytes() for b in np.packbits(bits, axis=1)])

    return df.mapInPandas(run, "id bigint, v array<float>, cell int, mark binary")


def _marked_cells(marks: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(marks, axis=0)))


def _own_cells(marks: np.ndarray) -> np.ndarray:
    return np.unique(marks.view(">i4"))


def _runs(queries, items):
    """The items of a block, cell by cell, with the queries that open the cell."""
    cells = items.marks.view(">i4").ravel()
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    for start, end in zip(starts, [*starts[1:], len(cells)]):
        rows = np.flatnonzero(queries.marks[:, cells[start] >> 3] & (128 >> (cells[start] & 7)))
        for at in range(start, end, SLICE):
            yield slice(at, min(at + SLICE, end)), rows


class CellIndex:
    """Vectors of a lakehouse table, dealt to cells around centres and stored by cell.

    Centres are fitted on at most ``SAMPLE_ROWS`` rows (those with the lowest hash of the id); every row is
    indexed. A search compares a query with the rows of its nearest cells; how many cells that takes for
    the wanted recall is measured against exact search when the index is built. Where it would take nearly all
    cells, and for queries whose cells hold fewer than ``k`` rows, the search is exact. Rows whose vector is
    null, empty or of another length than the first, or holds null or non-finite components, take no part.
    """

    def __init__(self, lake: Lakehouse, name: str, block_rows: int = 4096, bucket_rows: int = BUCKET_ROWS):
        self.lake, self.spark, self.name = lake, lake.spark, name
        self.block_rows, self.bucket_rows = block_rows, bucket_rows
        self._rows, self._centres = lake.key(f"{name}_cells", STATE), lake.key(f"{name}_centres", STATE)

    def exists(self) -> bool:
        return self._rows in self.lake.manifest().tables

    def build(self, items: DataFrame, id_col: str, vector: str, k: int = 20, recall: float = 0.9, seed: int = 42) -> None:
        """Replace the index by one over ``items`` (unique ids), in one batch."""
        items = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        size = items.where(F.size("v") > 0).agg(F.min_by(F.size("v"), "id")).first()[0]
        finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
        items = items.where((F.size("v") == (size or 0)) & F.coalesce(finite, F.lit(False)))
        n = items.count() if size else 0
        sample = items.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toPandas() if n else None
        wanted = min(MAX_CELLS, max(1, round(math.sqrt(n))))
        centres = _fit(_unit(np.stack(sample["v"]).astype(np.float64)), wanted, seed) if n else np.zeros((1, 1))
        dealt = _nearest_cells(items, centres, 1).select(*KEY)
        with self.lake.batch() as batch:
            buckets = min(MAX_BUCKETS, max(1, n // self.bucket_rows))
            parts = batch.stage_buckets(dealt, self._rows, F.pmod("cell", F.lit(buckets)), sort=["cell"])
            batch.put(self._rows, parts or [batch.stage(dealt, self._rows)], buckets=buckets, key=("cell",))
            probes = self._depth(batch.read_part(*parts), centres, k, recall) if parts else 1
            about = [(i, c.tolist(), probes, n) for i, c in enumerate(centres)]
            table = self.spark.createDataFrame(about, "cell int, centre array<double>, probes int, rows bigint")
            batch.put(self._centres, [batch.stage(table, self._centres)])

    def _depth(self, stored: DataFrame, centres: np.ndarray, k: int, recall: float) -> int:
        """Fewest cells that hold ``recall`` of the exact neighbours of the trial queries, and a margin of a tenth."""
        trial = stored.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIAL_QUERIES).select("id", "v")
        # At most TRIAL_QUERIES * k rows come to the driver.
        true = nearest_neighbours(trial, stored.select("id", "v"), "id", "v", k, self.block_rows)
        homes = stored.select(F.col("id").alias("item_id"), "cell")
        order = _nearest_cells(trial, centres, len(centres)).select(F.col("id").alias("query_id"), "cell", "place")
        places = true.join(homes, "item_id").join(order, ["query_id", "cell"]).select("place").toPandas()["place"]
        if places.empty:
            return 1
        reached = np.cumsum(np.bincount(places, minlength=len(centres))) / len(places)
        return min(len(centres), math.ceil(1.1 * (int(np.argmax(reached >= recall)) + 1)))

    def centres(self) -> tuple[np.ndarray, int, int]:
        """(centres, cells per query, rows of the index)."""
        held = self.lake.read(f"{self.name}_centres", STATE).orderBy("cell").toPandas()
        return np.stack(held["centre"]), int(held["probes"][0]), int(held["rows"][0])

    def _stored(self, probed: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the files that hold the cells of ``probed``."""
        entry = self.lake.manifest().tables[self._rows]
        parts = [p.path for p in entry.parts]
        if probed is not None and entry.buckets > 1:
            numbers = probed.select(F.pmod("cell", F.lit(entry.buckets))).distinct()
            used = {r[0] for r in numbers.collect()}  # at most MAX_BUCKETS numbers
            parts = [p.path for p in entry.parts if p.bucket in used] or parts
        return self.spark.read.schema("id bigint, v array<float>, cell int").parquet(*[f"{self.lake.root}/{p}" for p in parts])

    def _plain(self, queries: DataFrame, id_col: str, vector: str, size: int) -> DataFrame:
        plain = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        return plain.where(F.size("v") == size)

    def probed(self, queries: DataFrame, id_col: str, vector: str) -> DataFrame:
        """``id, v, cell, place``: the cells that a search opens for each query."""
        centres, probes, _ = self.centres()
        return _nearest_cells(self._plain(queries, id_col, vector, centres.shape[1]), centres, probes)

    def compared(self, queries: DataFrame, id_col: str, vector: str) -> int:
        """Pairs that ``search`` compares for these queries (those sent on to exact search left out)."""
        centres, probes, _ = self.centres()
        wanted = _wanted(self._plain(queries, id_col, vector, centres.shape[1]), centres, probes)
        sizes = self._stored().groupBy("cell").agg(F.count("*").alias("size"))
        return wanted.join(sizes, "cell").agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0

    def search(self, queries: DataFrame, id_col: str, vector: str, k: int = 20, exclude_self: bool = True) -> DataFrame:
        """``query_id, item_id, score, rank`` by cosine rounded to 4 digits, ties to the lower id.

        Queries and rows lie in blocks of neighbouring cells; a block of queries meets the blocks that hold one of
        its cells, and there each query the rows of its own cells.
        """
        centres, probes, n = self.centres()
        plain = self._plain(queries, id_col, vector, centres.shape[1])
        if probes > EXACT_ABOVE * len(centres):
            return nearest_neighbours(plain, self._stored(), "id", "v", k, self.block_rows, exclude_self)
        stored = self._stored(_wanted(plain, centres, probes))
        # The cell in four bytes, high ones first.
        items = stored.withColumn("mark", F.unhex(F.lpad(F.hex("cell"), 8, "0")))
        pairs = meet(
            packed(_marked(plain, centres, probes), plain.count(), self.block_rows, ["cell"], _marked_cells),
            packed(items, stored.count(), self.block_rows, ["cell"], _own_cells),
            k, exclude_self, _runs,
        )
        found = reliable_checkpoint(top_per_key(pairs, ["query_id"], [F.desc("score"), F.asc("item_id")], k))
        enough = min(k, n - 1 if exclude_self else n)
        full = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("_n")).where(F.col("_n") >= enough)
        short = plain.join(full, "id", "left_anti")
        if short.isEmpty():
            return found
        exact = nearest_neighbours(short, self._stored(), "id", "v", k, self.block_rows, exclude_self)
        return found.join(full.select(F.col("id").alias("query_id")), "query_id", "left_semi").unionByName(exact)
