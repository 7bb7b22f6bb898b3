"""Embedding collections and exact cosine search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.ordered import top_per_key
from tarnlake.session import reliable_checkpoint

TINY = 1e-9
BATCH = 64


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def embed_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    embed: Callable[[list[str]], Sequence[Sequence[float]]] | None = None,
    dimensions: int = 256,
) -> DataFrame:
    """``id, vector`` for every row with a text.

    ``embed`` maps a batch of texts to vectors and runs inside the tasks. Without it the
    vectors are normalised hashed TF-IDF weights, fitted over the whole collection.
    """
    rows = df.filter(F.col(text_col).isNotNull()).select(id_col, text_col)
    if embed is None:
        return _tfidf(rows, id_col, text_col, dimensions)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                vectors = [list(map(float, v)) for v in embed(part[text_col].tolist())]
                yield pd.DataFrame({id_col: part[id_col].tolist(), "vector": vectors})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"`{id_col}` {kind}, vector array<float>")


def _tfidf(rows: DataFrame, id_col: str, text_col: str, dimensions: int) -> DataFrame:
    words = RegexTokenizer(inputCol=text_col, outputCol="_w", pattern="[^a-z0-9]+").transform(rows)
    counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dimensions).transform(words)
    weighted = IDF(inputCol="_tf", outputCol="_x").fit(counted).transform(counted)
    unit = Normalizer(inputCol="_x", outputCol="_u").transform(weighted)
    return unit.select(id_col, vector_to_array("_u", "float32").alias("vector"))


def top_similar(df: DataFrame, id_col: str, vector: str, query: Column, k: int = 10) -> DataFrame:
    """``id, score`` of the ``k`` rows most similar to one query vector.

    The query travels as a one-row value; each partition keeps its own best ``k``.
    """
    ready = df.select(F.col(id_col), F.col(vector).alias("_v")).withColumn("_q", query)
    score = dot(F.col("_v"), F.col("_q")) / (norm(F.col("_v")) * norm(F.col("_q")) + TINY)
    return (
        ready.select(id_col, F.round(score, 4).alias("score"))
        .orderBy(F.desc("score"), id_col)
        .limit(k)
    )


def nearest_neighbours(
    queries: DataFrame,
    items: DataFrame,
    id_col: str,
    vector: str,
    k: int = 20,
    block_rows: int = 4096,
    exclude_self: bool = True,
) -> DataFrame:
    """Exact cosine k-NN: ``query_id, item_id, score, rank`` for every query row.

    Both sides are packed into blocks of about ``block_rows`` once; every block of queries
    meets the blocks of items one after the other and holds its best ``k`` so far, so no
    vector is copied per block, no pair is written out, and memory per task is bounded.
    Ties in the score rounded to 4 digits go to the lower id.
    """

    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    i = packed(plain(items), items.count(), block_rows)
    q = i if queries is items else packed(plain(queries), queries.count(), block_rows)
    return top_per_key(meet(q, i, k, exclude_self), ["query_id"], [F.desc("score"), F.asc("item_id")], k)


PACK = "block bigint, ids array<bigint>, vectors binary, marks binary, keys array<int>"


def packed(
    df: DataFrame,
    rows: int,
    block_rows: int,
    near: Sequence[str] = (),
    keys: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Rows ``id, v`` and perhaps ``mark`` as blocks of at most ``block_rows``, kept in the checkpoint folder.

    Every row is moved and written once. With ``near`` a block holds rows next to each other in that order;
    ``keys`` gives the keys of a block from its marks (a row of bytes each).
    """
    n = max(1, math.ceil(rows / block_rows))
    if near:
        # The hash cuts a range of equal values.
        dealt = df.repartitionByRange(n, *near, F.xxhash64("id")).sortWithinPartitions(*near)
    else:
        dealt = df.repartition(n)

    def block(number: int, table: pa.Table) -> pa.RecordBatch:
        v = table["v"].combine_chunks()
        lengths = {len(x) if x is not None else None for x in v.slice(0, 1)} | set(pc.unique(pc.list_value_length(v)).to_pylist())
        if len(lengths) > 1 or None in lengths:
            raise ValueError(f"vectors of lengths {sorted(map(str, lengths))}; all must have one length")
        flat = v.flatten().to_numpy(zero_copy_only=False).astype("<f4")
        marks = b"".join(table["mark"].to_pylist()) if "mark" in table.column_names else b""
        found = keys(np.frombuffer(marks, np.uint8).reshape(len(table), -1)) if keys else []
        columns = [[number], [table["id"].to_pylist()], [flat.tobytes()], [marks], [list(map(int, found))]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int32())]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["block", "ids", "vectors", "marks", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            while batch.num_rows:
                room = block_rows - sum(h.num_rows for h in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(h.num_rows for h in held) == block_rows:
                    yield block(number, pa.Table.from_batches(held))
                    number, held = number + 1, []
        if held:
            yield block(number, pa.Table.from_batches(held))

    return reliable_checkpoint(dealt.mapInArrow(run, PACK))


class _Side:
    """The rows of a block: ids, vectors, lengths and directions."""

    def __init__(self, ids: pa.ListScalar, vectors: bytes, marks: bytes):
        held = ids.values
        self.null = held.is_null().to_numpy(zero_copy_only=False)
        # Ties go to the lower id; an absent one is the lowest, as Spark orders it.
        self.ids = held.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        self.v = np.frombuffer(vectors, "<f4").reshape(len(self.ids), -1)
        wide = self.v.astype(np.float64)
        self.length = np.linalg.norm(wide, axis=1)
        with np.errstate(all="ignore"):
            self.unit = (wide / np.where(self.length > 0, self.length, 1)[:, None]).astype(np.float32)
        # Beside so short a vector ``TINY`` counts.
        self.short = np.flatnonzero(self.length < 0.01)
        self.marks = np.frombuffer(marks, np.uint8).reshape(len(self.ids), -1)


class _Best(_Side):
    """A block of queries with the best ``k`` items each has met so far."""

    def __init__(self, ids: pa.ListScalar, vectors: bytes, marks: bytes, k: int, exclude_self: bool, distinct: bool):
        super().__init__(ids, vectors, marks)
        self.k, self.exclude_self, self.distinct = k, exclude_self, distinct
        self.score = np.full((len(self.ids), k), -np.inf)
        self.item = np.full((len(self.ids), k), np.iinfo(np.int64).max)
        self.item_null = np.zeros((len(self.ids), k), bool)
        # A single-precision product of directions is at most so far from the score before it is rounded.
        self.off = 1.2e-5 + 1.2e-7 * self.v.shape[1]

    def meet(self, other: _Side, at: slice, rows: np.ndarray, met: Callable | None) -> None:
        """Take in the items ``at`` for the queries ``rows``; ``met`` says which pairs of indexes count."""
        if not len(rows):
            return
        items = np.arange(at.start, at.stop)
        with np.errstate(all="ignore"):
            sims = self.unit[rows] @ other.unit[at].T
            for own in np.flatnonzero(np.isin(rows, self.short)):
                sims[own] = self._exact(np.full(len(items), rows[own]), items, other)
            for column in np.flatnonzero(np.isin(items, other.short)):
                sims[:, column] = self._exact(rows, np.full(len(rows), items[column]), other)
        floor, last = self.score[rows, -1], self.item[rows, -1]
        low, half = floor - 5e-5 - self.off, 5e-5
        few = np.flatnonzero(floor == -np.inf)
        if len(few):
            part = sims[few]
            part[~np.isfinite(part)] = -np.inf
            everything = np.repeat(few, len(items)), np.tile(np.arange(len(items)), len(few))
            part[~self._counts(rows[everything[0]], items[everything[1]], other, met).reshape(part.shape)] = -np.inf
            keep = min(self.k, part.shape[1])
            bound = np.partition(part, part.shape[1] - keep, axis=1)[:, part.shape[1] - keep]
            if part.shape[1] < self.k or self.distinct and len(np.unique(other.ids[at])) < len(items):
                bound[:] = -np.inf
            low[few] = np.where(np.isfinite(bound), bound - 2 * (half + self.off), -4.0)
            sims[few] = part
        r, c = np.nonzero(sims >= low[:, None].astype(np.float32))
        # An item that can but reach the last score must have the lower id.
        near = (sims[r, c] >= (floor + half - self.off)[r]) | (other.ids[items[c]] < last[r])
        r, c = rows[r[near]], items[c[near]]
        counts = self._counts(r, c, other, met)
        r, c = r[counts], c[counts]
        if len(r):
            score = np.concatenate([self._exact(r[n : n + 65536], c[n : n + 65536], other) for n in range(0, len(r), 65536)])
            fine = np.isfinite(score)
            self._merge(r[fine], other.ids[c[fine]], other.null[c[fine]], np.round(score[fine], 4))

    def _exact(self, r: np.ndarray, c: np.ndarray, other: _Side) -> np.ndarray:
        products = np.einsum("ij,ij->i", self.v[r].astype(np.float64), other.v[c].astype(np.float64))
        return products / (self.length[r] * other.length[c] + TINY)

    def _counts(self, r: np.ndarray, c: np.ndarray, other: _Side, met: Callable | None) -> np.ndarray:
        out = np.ones(len(r), bool)
        if met is not None:
            for n in range(0, len(r), 65536):
                out[n : n + 65536] = met(self, other, r[n : n + 65536], c[n : n + 65536])
        if self.exclude_self:
            out &= (self.ids[r] != other.ids[c]) | self.null[r] | other.null[c]
        return out

    def _merge(self, r: np.ndarray, ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        own = np.unique(r)
        r = np.concatenate([np.repeat(own, self.k), r])
        ids = np.concatenate([self.item[own].ravel(), ids])
        null = np.concatenate([self.item_null[own].ravel(), null])
        score = np.concatenate([self.score[own].ravel(), score])
        if self.distinct:
            order = np.lexsort((-score, ids, r))
            again = (np.diff(r[order]) == 0) & (np.diff(ids[order]) == 0)
            score[order[1:][again]] = -np.inf
        order = np.lexsort((ids, -score, r))
        first = np.searchsorted(r[order], own)
        best = order[first[:, None] + np.arange(self.k)]
        self.score[own], self.item[own], self.item_null[own] = score[best], ids[best], null[best]

    def rows(self) -> pa.RecordBatch:
        r, place = np.nonzero(self.score > -np.inf)
        columns = [
            pa.array(self.ids[r], pa.int64(), mask=self.null[r]),
            pa.array(self.item[r, place], pa.int64(), mask=self.item_null[r, place]),
            pa.array(self.score[r, place], pa.float64()),
        ]
        return pa.record_batch(columns, ["query_id", "item_id", "score"])


#: Items that a block of queries is multiplied with at once.
SLICE = 1024


def _slices(best: _Best, items: _Side) -> Iterator[tuple[slice, np.ndarray]]:
    everyone = np.arange(len(best.ids))
    for at in range(0, len(items.ids), SLICE):
        yield slice(at, min(at + SLICE, len(items.ids))), everyone


def meet(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    exclude_self: bool,
    slices: Callable = _slices,
    met: Callable | None = None,
    distinct: bool = False,
) -> DataFrame:
    """``query_id, item_id, score``: the best ``k`` items of every query, from blocks of both (``packed``).

    A task holds a block of queries and reads the blocks of items one after the other. Blocks that name keys
    meet where they share one; ``slices`` gives the items of a block with the queries they are for, ``met`` the
    pairs that count. With ``distinct`` an item id that repeats counts once, with its best score.
    """
    blocks = max(1, queries.count())
    # Many blocks of queries occupy all cores; few ones share out the items, then each part gives its own best k.
    parts = max(1, math.ceil(2 * queries.sparkSession.sparkContext.defaultParallelism / blocks))
    left = items.select(*[F.col(c).alias(f"i_{c}") for c in items.columns]).coalesce(parts)
    right = queries.hint("shuffle_replicate_nl")
    keyed = F.arrays_overlap("keys", "i_keys") | ((F.size("keys") == 0) & (F.size("i_keys") == 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Best] = {}
        at, items = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n] for name in batch.schema.names}
                if (number := row["block"].as_py()) not in held:
                    held[number] = _Best(row["ids"], row["vectors"].as_py(), row["marks"].as_py(), k, exclude_self, distinct)
                if row["i_block"].as_py() != at:
                    at, items = row["i_block"].as_py(), _Side(row["i_ids"], row["i_vectors"].as_py(), row["i_marks"].as_py())
                for part, rows in slices(held[number], items):
                    held[number].meet(items, part, rows, met)
        for best in held.values():
            yield best.rows()

    return left.join(right, keyed, "inner").drop("keys", "i_keys").mapInArrow(run, "query_id bigint, item_id bigint, score double")


def _score_blocks(
    left: DataFrame, right: DataFrame, cell: Sequence[str], k: int, exclude_self: bool
) -> DataFrame:
    """Best ``k`` items per query inside every cell of two blocked sides ``id, v``."""

    def score(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if q.empty or i.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        a = np.stack(q["v"].to_numpy()).astype(np.float64)
        b = np.stack(i["v"].to_numpy()).astype(np.float64)
        qids, ids = q["id"].to_numpy(), i["id"].to_numpy()
        lengths = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        sims = np.round(a @ b.T / (lengths + TINY), 4)
        if exclude_self:
            sims[qids[:, None] == ids[None, :]] = -np.inf
        keep = min(k, sims.shape[1])
        # Everything at or above the k-th best value, so ties are settled by id.
        floor = np.partition(sims, sims.shape[1] - keep, axis=1)[:, sims.shape[1] - keep]
        best = []
        for row in range(len(qids)):
            near = np.flatnonzero((sims[row] >= floor[row]) & np.isfinite(sims[row]))
            best.append(near[np.lexsort((ids[near], -sims[row, near]))][:keep])
        rows = np.repeat(np.arange(len(qids)), [len(n) for n in best])
        columns = np.concatenate(best)
        return pd.DataFrame(
            {"query_id": qids[rows], "item_id": ids[columns], "score": sims[rows, columns]}
        )

    return (
        left.groupBy(*cell)
        .cogroup(right.groupBy(*cell))
        .applyInPandas(score, "query_id bigint, item_id bigint, score double")
    )


def nearest_neighbours_lsh(
    queries: DataFrame,
    items: DataFrame,
    id_col: str,
    vector: str,
    dimensions: int,
    k: int = 20,
    planes: int = 8,
    tables: int = 8,
    block_rows: int = 4096,
    exclude_self: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Approximate cosine k-NN for sides too large for all block pairs.

    Random hyperplanes give every vector one bucket per hash table; only vectors that
    share a bucket are compared. A bucket of any size is cut into blocks, so a bucket with a
    third of all rows becomes many bounded tasks. Where the buckets together hold a quarter of
    all pairs or more, every pair of blocks is met once instead, as in the exact search, and
    pairs without a common bucket are left out there. Scores of the pairs found are exact;
    pairs that share no bucket are missed.
    """
    normals = np.random.default_rng(seed).standard_normal((tables, planes, dimensions))
    weights = 2 ** np.arange(planes)

    def buckets(frame: pd.DataFrame) -> np.ndarray:
        points = np.stack(frame["v"].to_numpy()).astype(np.float64)
        return np.stack([((points @ n.T) > 0) @ weights for n in normals], axis=1).astype("<i8")

    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def counts(df: DataFrame, name: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if frame.empty:
                    continue
                own = buckets(frame)
                for t in range(tables):
                    found, n = np.unique(own[:, t], return_counts=True)
                    yield pd.DataFrame({"hash_table": t, "bucket": found, "n": n})

        each = plain(df).mapInPandas(run, "hash_table int, bucket bigint, n bigint")
        return each.groupBy("hash_table", "bucket").agg(F.sum("n").alias(name))

    # One row per bucket in use: at most tables * 2 ** planes rows.
    sizes = reliable_checkpoint(counts(queries, "n_q").join(counts(items, "n_i"), ["hash_table", "bucket"]))
    n_q, n_i = queries.count(), items.count()
    compared = sizes.agg(F.sum(F.col("n_q").cast("double") * F.col("n_i"))).first()[0] or 0.0
    if 4 * compared >= n_q * n_i:
        parts = _lsh_in_one_pass(plain(queries), plain(items), n_q, n_i, buckets, k, block_rows, exclude_self)
    else:
        parts = _lsh_by_bucket(plain(queries), plain(items), sizes, buckets, k, block_rows, exclude_self)
    # A pair found in several tables has the same score in each.
    pairs = parts.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return top_per_key(pairs, ["query_id"], [F.desc("score"), F.asc("item_id")], k)


def _lsh_in_one_pass(queries, items, n_q, n_i, buckets, k, block_rows, exclude_self) -> DataFrame:
    """Every pair of blocks once; pairs with a common bucket in any table count."""

    def coded(df: DataFrame, n: int) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not frame.empty:
                    yield frame.assign(mark=[own.tobytes() for own in buckets(frame)])

        return packed(df.mapInPandas(run, "id bigint, v array<float>, mark binary"), n, block_rows)

    def met(q: _Best, i: _Side, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (q.marks.view("<i8")[r] == i.marks.view("<i8")[c]).any(axis=1)

    return meet(coded(queries, n_q), coded(items, n_i), k, exclude_self, met=met, distinct=True)


def _lsh_by_bucket(queries, items, sizes, buckets, k, block_rows, exclude_self) -> DataFrame:
    """Every bucket apart, in blocks; a row goes to its buckets of all tables."""

    def bucketed(df: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not frame.empty:
                    for t, bucket in enumerate(buckets(frame).T):
                        yield frame.assign(hash_table=t, bucket=bucket)

        return df.mapInPandas(run, "id bigint, v array<float>, hash_table int, bucket bigint")

    blocks = sizes.select(
        "hash_table", "bucket", *[F.ceil(F.col(n) / block_rows).cast("bigint").alias(n) for n in ("n_q", "n_i")]
    )

    def blocked(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        return bucketed(df).join(blocks, ["hash_table", "bucket"]).select(
            "id", "v", "hash_table", "bucket",
            F.pmod(F.xxhash64("id"), F.col(n_own)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n_other) - 1)).alias(other),
        )

    return _score_blocks(
        blocked(queries, "qb", "n_q", "ib", "n_i"),
        blocked(items, "ib", "n_i", "qb", "n_q"),
        ["hash_table", "bucket", "qb", "ib"],
        k,
        exclude_self,
    )


def collection_status(configured: DataFrame, built: DataFrame) -> DataFrame:
    """Every configured collection with ``is_built, vectors, dimensions``.

    ``configured`` has ``collection``; ``built`` has ``collection, vector``.
    """
    made = built.groupBy("collection").agg(
        F.count("*").alias("vectors"), F.max(F.size("vector")).alias("dimensions")
    )
    return configured.join(made, "collection", "left").select(
        "collection",
        F.col("vectors").isNotNull().alias("is_built"),
        F.coalesce("vectors", F.lit(0)).alias("vectors"),
        F.coalesce("dimensions", F.lit(0)).alias("dimensions"),
    )
