"""Word hashes of whole Arrow batches with numpy; used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_factors = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def factors(n: int) -> np.ndarray:
    """One multiplier for each place in a word."""
    global _factors
    if len(_factors) < n:
        _factors = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _factors


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each text starts and ends; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of the first word of each text (and of the end)."""
    inside = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # texts touch: a border ends a word
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes (spans ascend and do not overlap)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    values = raw[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    values *= factors(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of consecutive hashes, in order."""
    out = np.zeros(len(parts[0]), np.uint64)
    for k, part in enumerate(parts):
        out += part * _factors[200 + k]
    return mix(out)


#: Bytes of texts whose words are hashed at once: that takes some 50 times as much, and workers hold on to what they once took.
HASHED = 500_000


def slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000):
    """Cut a batch so that the texts of a piece stay near ``limit`` bytes (one text may be longer)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)
