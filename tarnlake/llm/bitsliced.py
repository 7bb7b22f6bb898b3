"""Exact top-k search by inner product over a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.llm.common import repeated, saved

#: Candidates in one block of the index, and queries that meet a block at once.
BLOCK_ROWS = 32_768
QUERY_ROWS = 512
#: Vectors with a component beyond this (after quantising) are scored number by number: sums of slices must fit 64 bits.
LARGEST = 1 << 22
LONGS = np.iinfo(np.int64)


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v: floor(scale * x) per component; rows that take no part are left out."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    # An expression of nulls is null, not true: such rows go too.
    kept = vectors.where(F.coalesce(usable, F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    large = F.exists("v", lambda x: (x > LARGEST) | (x < -LARGEST))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).withColumn("large", large)


def _padded(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _slices(rows: pd.DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids, lowest value per component, and bitmaps [component, bit, word] of the values above it."""
    values = _padded(rows["v"], dims)
    low = values.min(axis=0)
    above = values - low
    bits = max(1, int(above.max()).bit_length())
    padded = -(-len(rows) // 64) * 64
    maps = np.zeros((dims, bits, padded // 64), np.uint64)
    for b in range(bits):
        column = np.zeros((dims, padded), np.uint8)
        column[:, : len(rows)] = (above.T >> b) & 1
        maps[:, b] = np.packbits(column, axis=1, bitorder="little").view(np.uint64)
    return rows["vec_id"].to_numpy(np.int64), low, maps, bits


def _sum_slices(query: np.ndarray, maps: np.ndarray, full: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of sum(|q| * a) over components, a being the value or, for q < 0, its complement."""
    dims, bits, width = maps.shape
    by_weight: dict[int, list[np.ndarray]] = {}
    for i in np.flatnonzero(query):
        q = abs(int(query[i]))
        for b in range(bits):
            one = maps[i, b] if query[i] > 0 else maps[i, b] ^ full
            j, rest = 0, q
            while rest:
                if rest & 1:
                    by_weight.setdefault(b + j, []).append(one)
                rest >>= 1
                j += 1
    out, weight = [], 0
    while by_weight and weight <= max(by_weight):
        held = by_weight.pop(weight, [])
        carry = by_weight.setdefault(weight + 1, []) if len(held) > 1 else None
        while len(held) > 2:  # three bitmaps of one weight make one of it and one of the next
            a, b, c = held.pop(), held.pop(), held.pop()
            half = a ^ b
            carry.append((a & b) | (half & c))
            held.insert(0, half ^ c)
        if len(held) == 2:
            a, b = held
            carry.append(a & b)
            held = [a ^ b]
        out.append(held[0] if held else np.zeros(width, np.uint64))
        weight += 1
    return out, len(out)


def _best(slices: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of rows surely in the top k and of rows tied on the border, from the highest slice down."""
    sure, open_ = np.zeros_like(allowed), allowed
    for s in reversed(slices):
        with_bit = open_ & s
        n = int(np.bitwise_count(sure).sum() + np.bitwise_count(with_bit).sum())
        if n > k:
            open_ = with_bit
        else:
            sure = sure | with_bit
            open_ = open_ & ~s
            if n == k:
                return sure, np.zeros_like(open_)
    return sure, open_


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _search(ids, low, maps, bits, query_ids, queries, k) -> list[tuple]:
    full = np.zeros(maps.shape[2] * 64, np.uint8)
    full[: len(ids)] = 1
    full = np.packbits(full, bitorder="little").view(np.uint64)
    order = np.argsort(ids, kind="stable")
    found = []
    for query_id, q in zip(query_ids.tolist(), queries, strict=True):
        slices, _ = _sum_slices(q, maps, full)
        allowed = full.copy()
        lo, hi = np.searchsorted(ids, query_id, sorter=order), np.searchsorted(ids, query_id, "right", sorter=order)
        for own in order[lo:hi]:
            allowed[own >> 6] &= ~np.uint64(1 << int(own & 63))
        sure, tied = _best(slices, allowed, k)
        rows = _rows(sure)
        border = _rows(tied)  # equal scores: the smallest ids win
        rows = np.concatenate([rows, border[np.argsort(ids[border], kind="stable")][: k - len(rows)]])
        score = np.zeros(len(rows), np.int64)
        for w, s in enumerate(slices):
            score += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        # Slices hold sum(|q| * (v - low)), or of the complement 2**bits - 1 - (v - low) where q < 0.
        score += int((q * low).sum()) + int(q[q < 0].sum()) * ((1 << bits) - 1)
        found += [(query_id, int(ids[r]), int(s)) for r, s in zip(rows, score, strict=True)]
    return found


def _values(low: np.ndarray, maps: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The vectors of a block back from its bitmaps."""
    out = np.tile(low, (n, 1))
    for b in range(bits):
        out += np.unpackbits(maps[:, b].copy().view(np.uint8), axis=1, bitorder="little")[:, :n].T.astype(np.int64) << b
    return out


def _search_exactly(ids, values, query_ids, queries, k) -> list[tuple]:
    """The same for numbers of any size; scores beyond 64 bits count as the nearest long."""
    found, whole = [], values.astype(object)
    for query_id, q in zip(query_ids.tolist(), queries, strict=True):
        scores = np.clip(whole @ q.astype(object), LONGS.min, LONGS.max).astype(np.int64)
        rows = np.flatnonzero(ids != query_id)
        best = rows[np.lexsort((ids[rows], ~scores[rows]))][:k]
        found += [(query_id, int(ids[r]), int(scores[r])) for r in best]
    return found


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds, the k highest inner products.

    Ties go to the smaller vec_id; rows of a query's own vec_id are no candidates for it. Vectors that are
    null or hold a null or non-finite component, and rows without an id, take no part. Other repeated rows
    each count, and a repeated query row has its answer as often. A shorter vector counts as padded with
    zeros; components and scores beyond 64 bits count as the nearest long. Candidates are indexed in
    blocks of bounded size and queries meet them block by block; each block keeps k per query. Vectors
    with very large components have blocks of their own, whose values are kept as numbers.
    """
    rows = quantised(vectors, scale)
    asked = saved(
        rows.where(is_query).groupBy("vec_id", "v", "large").agg(F.count("*").alias("times")).withColumn("q", F.monotonically_increasing_id()), "queries"
    )
    n, n_large, dims = rows.agg(F.count("*"), F.count_if("large"), F.max(F.size("v"))).first()
    n_queries, n_large_queries = asked.agg(F.count("*"), F.count_if("large")).first()
    dims = max(1, dims or 1)
    n_blocks, n_large_blocks = max(1, -(-n // BLOCK_ROWS)), -(-n_large // BLOCK_ROWS)
    n_groups, n_large_groups = max(1, -(-n_queries // QUERY_ROWS)), -(-n_large_queries // QUERY_ROWS)

    def index(block: pd.DataFrame) -> pd.DataFrame:
        number = block["block"].iloc[0]
        if number < n_blocks:
            ids, low, maps, bits = _slices(block, dims)
        else:  # no bits: the numbers themselves
            ids, low, maps, bits = block["vec_id"].to_numpy(np.int64), np.zeros(0, np.int64), _padded(block["v"], dims), 0
        return pd.DataFrame({"block": [number], "ids": [ids.tobytes()], "low": [low.tobytes()], "maps": [maps.tobytes()], "bits": [bits]})

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        q, ids = group["q"].to_numpy(np.int64), group["vec_id"].to_numpy(np.int64)
        large = bool(group["large"].iloc[0])
        return pd.DataFrame({"q": [q.tobytes()], "query_ids": [ids.tobytes()], "queries": [_padded(group["v"], dims).tobytes()], "large": [large]})

    def search(frames):
        for frame in frames:
            for r in frame.itertuples():
                ids, low = np.frombuffer(r.ids, np.int64), np.frombuffer(r.low, np.int64)
                query_ids = np.frombuffer(r.query_ids, np.int64)
                queries = np.frombuffer(r.queries, np.int64).reshape(-1, dims)
                # Queries go by their place in the group: ids may repeat.
                if not r.bits:
                    hits = [_search_exactly(ids, np.frombuffer(r.maps, np.int64).reshape(-1, dims), query_ids[i : i + 1], queries[i : i + 1], k) for i in range(len(queries))]
                else:
                    maps = np.frombuffer(r.maps, np.uint64).reshape(dims, r.bits, -1)
                    if r.large:
                        values = _values(low, maps, r.bits, len(ids))
                        hits = [_search_exactly(ids, values, query_ids[i : i + 1], queries[i : i + 1], k) for i in range(len(queries))]
                    else:
                        hits = [_search(ids, low, maps, r.bits, query_ids[i : i + 1], queries[i : i + 1], k) for i in range(len(queries))]
                q = np.frombuffer(r.q, np.int64)
                flat = [(q[i], found, score) for i, of_query in enumerate(hits) for _, found, score in of_query]
                yield pd.DataFrame(flat, columns=["q", "vec_id", "score"]).astype("int64")

    def dealt(key, usual: int, large: int):
        return F.when(F.col("large"), usual + F.pmod(key, F.lit(max(1, large)))).otherwise(F.pmod(key, F.lit(usual))).cast("int")

    # The row's number deals a repeated row over all blocks.
    place = F.xxhash64("vec_id", F.monotonically_increasing_id())
    blocks = rows.withColumn("block", dealt(place, n_blocks, n_large_blocks)).groupBy("block").applyInPandas(
        index, "block int, ids binary, low binary, maps binary, bits int"
    )
    groups = (
        asked.withColumn("part", dealt(F.xxhash64("q"), n_groups, n_large_groups))
        .groupBy("part").applyInPandas(gather, "q binary, query_ids binary, queries binary, large boolean")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks + n_large_blocks - 1))))
    )
    # Few rows, much work in each: one task per pair of a block and a group of queries.
    pairs = groups.join(blocks, "block").repartition(max(1, min((n_blocks + n_large_blocks) * (n_groups + n_large_groups), 10_000)))
    hits = pairs.mapInPandas(search, "q long, vec_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    answers = ranked.join(asked.select("q", F.col("vec_id").alias("query_id"), "times"), "q")
    return repeated(answers.select("query_id", "rank", "vec_id", "score", "times"), "times")
