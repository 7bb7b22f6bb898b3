"""Suffix-array dedup: bytes covered by long strings that also start elsewhere are removed."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import saved
from tarnlake.llm.hashing import mix, slices, text_bytes

#: Length of a string that counts as repeated, in bytes.
LENGTH = 200
#: Bytes of a seed; each window of LENGTH bytes is filed under the seed with the smallest hash in it.
SEED_BYTES = 32
#: Bytes of contexts in one shard.
SHARD_BYTES = 1 << 20

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E6C63D0876A9A47 | 1
_UNDO = pow(_BASE, -1, 1 << 64)
_powers = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    global _powers
    if _powers.shape[1] < n:
        out = np.ones((2, 2 * n), np.uint64)
        out[0, 1:], out[1, 1:] = _BASE, _UNDO
        _powers = np.multiply.accumulate(out, axis=1)
    return _powers


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(len(raw) + 1)[0, : len(raw)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return mix((sums[stops] - sums[starts]) * powers(len(sums))[1, starts])


def seeds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows filed under one seed: text, first window, number of windows, seed hash, hash of all bytes.

    Equal windows hold equal seeds at equal places, wherever they stand.
    """
    empty = np.zeros(0, np.int64)
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return empty, empty, empty, empty, empty
    sums = prefix_sums(raw)
    place = np.arange(len(raw) - SEED_BYTES + 1)
    hashes = span_hash(sums, place, place + SEED_BYTES)
    bits = np.uint64(32)  # the same everywhere: which seed is least depends on the window's bytes alone
    least = ((hashes >> bits) << bits) | place.astype(np.uint64)  # the leftmost of equals
    width, have = LENGTH - SEED_BYTES + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: n], least[width - have : width - have + n])
    seed = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(n), "right") - 1
    whole = np.arange(n) + LENGTH <= offsets[text + 1]
    # Windows that end beyond their text are none; they also end runs.
    key = np.where(whole, seed, -1)
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]))
    stop = np.append(edge[1:], n)
    good = key[edge] >= 0
    edge, stop = edge[good], stop[good]
    return text[edge], edge - offsets[text[edge]], stop - edge, hashes[key[edge]], span_hash(sums, edge, stop - 1 + LENGTH)


def suffix_array(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, by Larsson-Sadakane refinement.

    ``words`` holds the 8 bytes from each place on as a big-endian number; a suffix ends where its string
    does (``ends``), with a sign of its own. A group is numbered by the place of its last member; each
    round sorts the members of open groups by the group h bytes on.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    change = np.append(words[order][1:] != words[order][:-1], True)
    last = np.flatnonzero(change)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(last, np.diff(last, prepend=-1))
    open_ = np.flatnonzero(~(change & np.concatenate([[True], change[:-1]])))
    h = 8
    while len(open_):
        members = order[open_]
        own, at = group[members], members + h
        # Beyond its end a suffix meets a sign of its own, below every group.
        ahead = np.where(at < ends[members], group[np.minimum(at, n - 1)], -1 - members)
        by = np.lexsort((ahead, own))
        members, own, ahead = members[by], own[by], ahead[by]
        order[open_] = members
        closes = np.flatnonzero(np.append((own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1]), True))
        counts = np.diff(closes, prepend=-1)
        group[members] = np.repeat(open_[closes], counts)
        open_ = open_[np.repeat(counts > 1, counts)]
        h *= 2
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, ends: np.ndarray, cap: int, stride: int = 32) -> np.ndarray:
    """Bytes (up to ``cap``) that each suffix shares with the one before it in ``order``, by place.

    Kasai's bound: a suffix shares at most one byte less with its predecessor than the suffix a place
    before does. Every ``stride``-th place is compared from the start, the others from that bound on.
    """
    n = len(words)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    room = np.minimum(cap, np.where(before >= 0, np.minimum(ends - place, ends[before] - before), 0))
    length = np.zeros(n, np.int64)

    def extend(rows: np.ndarray) -> None:
        rows = rows[length[rows] < room[rows]]
        while len(rows):
            differ = words[rows + length[rows]] ^ words[before[rows] + length[rows]]
            equal = np.zeros(len(rows), np.int64)  # leading equal bytes
            for k in range(1, 9):
                equal += (differ >> np.uint64(64 - 8 * k)) == 0
            length[rows] = np.minimum(length[rows] + equal, room[rows])
            rows = rows[(equal == 8) & (length[rows] < room[rows])]

    anchors = place[::stride]
    extend(anchors)
    length = np.maximum(length[place // stride * stride] - place % stride, 0)
    length = np.minimum(length, room)
    extend(np.setdiff1d(place, anchors, assume_unique=True))
    return length


def big_words(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; zeros beyond the end of the place's string."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(raw), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(raw)]
    beyond = np.maximum(0, 8 - (ends - np.arange(len(raw)))).astype(np.uint64) * np.uint64(8)
    return (out >> beyond) << beyond


class Shard:
    """The contexts of a shard as one text, and its windows of LENGTH bytes in classes of equals."""

    def __init__(self, frame: pd.DataFrame):
        self.keys, self.first = frame["key"].to_numpy(), frame["p"].to_numpy()
        sizes = frame["context"].str.len().to_numpy()
        raw = np.frombuffer(b"".join(frame["context"]), np.uint8)
        borders = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.repeat(borders[1:], sizes)
        words = big_words(raw, ends)
        order = suffix_array(words, ends)
        shared = common_prefixes(words, order, ends, LENGTH)
        label = np.empty(len(raw), np.int64)
        label[order] = np.cumsum(shared[order] < LENGTH)
        #: Windows in text order, their context, and whether an equal one is in the shard.
        self.at = np.flatnonzero(ends - np.arange(len(raw)) >= LENGTH)
        self.context = np.searchsorted(borders, self.at, "right") - 1
        self.twice = np.bincount(label[self.at])[label[self.at]] > 1
        self.borders, self.raw = borders, raw

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_sums(self.raw), self.at, self.at + LENGTH)

    def spans(self, hit: np.ndarray) -> pd.DataFrame:
        """Runs of hit windows as spans of their documents."""
        at, context = self.at[hit], self.context[hit]
        if not len(at):
            return pd.DataFrame({"key": [], "s": [], "e": []}, dtype="int64")
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(context) != 0)])
        begin, stop = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)) - 1
        base = self.first[context[begin]] - self.borders[context[begin]]
        return pd.DataFrame({"key": self.keys[context[begin]], "s": at[begin] + base, "e": at[stop] + base + LENGTH})


def _seed_rows(docs: DataFrame) -> DataFrame:
    """fp, ctx, key, pn: one row per run of windows; pn is 256 * first place + number of windows."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                text, place, count, seed, whole = seeds(*text_bytes(part.column("text")))
                keys = part.column("key").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(keys[text]), pa.array(place * 256 + count)],
                    names=["fp", "ctx", "key", "pn"],
                )

    return docs.select("key", "text").mapInArrow(run, "fp long, ctx long, key long, pn long")


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """Of each shard's sorted hashes, those that binary search finds in another shard of the same seed."""
    pieces = [np.frombuffer(x, np.uint64) for x in frame["hashes"]]
    out = []
    for i, own in enumerate(pieces):
        found = np.zeros(len(own), bool)
        for j, other in enumerate(pieces):
            if i != j and len(other):
                at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                found |= other[at] == own
        out.append(own[found].tobytes())
    return pd.DataFrame({"fp": frame["fp"], "salt": frame["salt"], "hashes": out})


def _across(contexts: DataFrame) -> DataFrame:
    """key, s, e for seeds whose contexts fill several shards: shards are merged by binary search."""

    def lists(frame: pd.DataFrame) -> pd.DataFrame:
        shard, cuts = Shard(frame), int(frame["cuts"].iloc[0])
        hashes = np.unique(shard.hashes())
        bucket = (hashes >> np.uint64(40)).astype(np.int64) % cuts
        rows = [(frame["fp"].iloc[0], frame["salt"].iloc[0], b, hashes[bucket == b].tobytes()) for b in range(cuts)]
        return pd.DataFrame(rows, columns=["fp", "salt", "bucket", "hashes"])

    def spans(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"key": [], "s": [], "e": []}, dtype="int64")
        shard = Shard(frame)
        elsewhere = np.frombuffer(b"".join(found["hashes"]), np.uint64)
        return shard.spans(shard.twice | np.isin(shard.hashes(), elsewhere))

    found = (
        contexts.groupBy("fp", "salt").applyInPandas(lists, "fp long, salt int, bucket int, hashes binary")
        .groupBy("fp", "bucket").applyInPandas(_merge, "fp long, salt int, hashes binary")
    )
    return contexts.groupBy("fp", "salt").cogroup(found.groupBy("fp", "salt")).applyInPandas(spans, "key long, s long, e long")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans key, s, e covered by strings that also start elsewhere (they may overlap), and the texts they are in.

    Windows of LENGTH bytes meet under the seed they are filed under. Runs of windows whose bytes are all
    the same elsewhere are repeated as a whole; the others bring their bytes (contexts, equal ones once)
    to shards, whose suffix arrays tell which windows are equal.
    """
    rows = _seed_rows(docs)
    shared = rows.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp")
    rows = saved(rows.join(shared, "fp"), "seeds")
    classes = rows.groupBy("fp", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("key", "pn")).alias("one"))
    classes = saved(classes, "classes")
    whole = rows.join(classes.where("c > 1").select("fp", "ctx"), ["fp", "ctx"])
    first, number = F.floor(F.col("pn") / 256).cast("long"), F.col("pn") % 256
    whole = whole.select("key", first.alias("s"), (first + number - 1 + LENGTH).alias("e"))

    mass = F.sum((F.col("one.pn") % 256) - 1 + LENGTH).alias("mass")
    partly = classes.groupBy("fp").agg(F.count("*").alias("n"), F.min("c").alias("least"), mass).where("n > 1 and least = 1")
    partly = partly.withColumn("cuts", F.ceil(F.col("mass") / SHARD_BYTES).cast("int")).select("fp", "mass", "cuts")
    wanted = classes.join(partly, "fp").select("fp", "cuts", "one.key", "one.pn")
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("fp", "cuts", "pn")).alias("wanted"))
    needed = whole.select("key").distinct().join(by_text, "key", "full")
    texts = saved(docs.select("key", "text").join(needed, "key"), "texts")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for key, text, items in zip(*(part.column(c).to_pylist() for c in ("key", "text", "wanted")), strict=True):
                    raw = text.encode()
                    for item in items:
                        p, n = divmod(item["pn"], 256)
                        out.append((item["fp"], item["cuts"], key, p, raw[p : p + n - 1 + LENGTH]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()])],
                    names=["fp", "cuts", "key", "p", "context"],
                )

    # Repeated rows share a key; their contexts are taken once.
    once = texts.where("wanted is not null").dropDuplicates(["key"])
    contexts = saved(once.select("key", "text", "wanted").mapInArrow(cut, "fp long, cuts int, key long, p long, context binary"), "contexts")
    total = contexts.where("cuts = 1").agg(F.sum(F.length("context"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    within = (
        contexts.where("cuts = 1").withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(shards)))
        .groupBy("shard").applyInPandas(lambda f: (s := Shard(f)).spans(s.twice), "key long, s long, e long")
    )
    spans = whole.unionByName(within)
    large = contexts.where("cuts > 1")
    if not large.isEmpty():
        salt = F.pmod(F.xxhash64("key", "p"), F.col("cuts")).cast("int")
        spans = spans.unionByName(_across(large.withColumn("salt", salt)))
    return spans, texts.select("key", "text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    Removed is each byte of a LENGTH-byte string that also starts anywhere else, in the same text or
    another, judged on the input. A null text is empty. A repeated row repeats the other's strings. An
    empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    spans, texts = repeated_spans(docs)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def take_out(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for key, text, spans in zip(*(part.column(c).to_pylist() for c in ("key", "text", "spans")), strict=True):
                    raw, kept, end, n = text.encode(), hashlib.sha256(), -1, 0
                    removed = left = 0
                    for s, e in sorted((x["s"], x["e"]) for x in spans):
                        if s > end:  # spans that touch are one run
                            kept.update(raw[left:s])
                            n, removed, left = n + 1, removed + e - s, e
                            end = e
                        elif e > end:
                            removed, left, end = removed + e - end, e, e
                    kept.update(raw[left:])
                    out.append((key, removed, n, kept.hexdigest()))
                yield pa.RecordBatch.from_pydict(
                    dict(zip(("key", "n_removed", "n_spans", "sha"), zip(*out, strict=True), strict=True)) if out else {"key": [], "n_removed": [], "n_spans": [], "sha": []},
                    pa.schema([("key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string())]),
                )

    changed = texts.join(spans, "key").mapInArrow(take_out, "key long, n_removed long, n_spans long, sha string")
    all_ = docs.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("all_sha"))
    zero = F.lit(0).cast("long")
    return all_.join(changed.dropDuplicates(["key"]), "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("sha", "all_sha").alias("kept_sha256"),
    )
