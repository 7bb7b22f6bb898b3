"""Hierarchical multi-length packing of documents into training sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Context sizes, largest first; a sequence of exactly one of them needs no padding.
TIERS = (2048, 1024, 512, 256)
#: Id that ends a document.
END = 1
#: Tokens of one step group: sequences of one tier that make up as much work as any other group.
STEP_TOKENS = 16 * 2048
#: Tokens that wait for partners before they are packed, and that may wait on afterwards.
HELD_TOKENS = 1 << 18
#: Characters tokenised at once.
BATCH_CHARS = 1 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, ids: np.ndarray, start: int, total: int):
        self.doc, self.ids, self.start, self.total = doc, ids, start, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.ids[:n], self.start, self.total), Piece(self.doc, self.ids[n:], self.start + n, self.total)


class Packer:
    """Packs the documents of one partition as they stream by; what waits is bounded."""

    def __init__(self, number: int, tiers=TIERS):
        self.tiers, self.base = tiers, number << 36
        self.pool: list[tuple[int, int, Piece]] = []  # ascending by length
        self.serial = self.held = self.sequences = 0
        self.in_tier = dict.fromkeys(tiers, 0)
        self.rows: list[tuple] = []

    def put(self, piece: Piece) -> None:
        self.serial += 1
        self.held += len(piece.ids)
        insort(self.pool, (len(piece.ids), self.serial, piece))

    def take(self, i: int) -> Piece:
        n, _, piece = self.pool.pop(i)
        self.held -= n
        return piece

    def add(self, doc, ids: np.ndarray) -> None:
        """Whole long windows go out at once; the rest waits in the tier of its length."""
        long, rest = self.tiers[0], Piece(doc, ids, 0, len(ids))
        while len(rest.ids) >= long:
            window, rest = rest.cut(long)
            self.emit([window], long)
        if len(rest.ids):
            rest.ids = rest.ids.copy()  # lets go of the document
            self.put(rest)

    def emit(self, window: list[Piece], tier: int) -> None:
        sequence = self.base + self.sequences
        # Groups of equal work within a tier, numbered so that no two tiers or partitions share one.
        step = self.base + self.in_tier[tier] * tier // STEP_TOKENS * len(self.tiers) + self.tiers.index(tier)
        self.sequences += 1
        self.in_tier[tier] += 1
        offset = 0
        for p in window:
            n = len(p.ids)
            crc = zlib.crc32(np.ascontiguousarray(p.ids, "<u4").tobytes())
            self.rows.append((p.doc, p.start, n, crc, p.total, sequence, offset, tier, step))
            offset += n

    def fill(self, tier: int, force: bool) -> None:
        """Start a window with each piece that belongs in this tier; fill its gap from shorter tiers."""
        last = tier == self.tiers[-1]
        while self.pool and self.pool[-1][0] > (0 if last else tier // 2):
            at = bisect_right(self.pool, (tier, float("inf"))) - 1
            if at < 0 or self.pool[at][0] <= (0 if last else tier // 2):
                return
            window = [self.take(at)]
            gap = tier - len(window[0].ids)
            while gap:
                shorter = len(self.pool) if last else bisect_right(self.pool, (tier // 2, float("inf")))
                if not shorter:
                    break
                i = min(bisect_right(self.pool, (gap, float("inf"))), shorter) - 1
                if i >= 0:  # the longest that fits whole
                    window.append(self.take(i))
                else:  # all are longer than the gap: the shortest is cut
                    head, tail = self.take(0).cut(gap)
                    window.append(head)
                    self.put(tail)
                gap -= len(window[-1].ids)
            if not gap:
                self.emit(window, tier)
            elif force and not last:  # half the window is full: it becomes a sequence of the next tier
                need, half = tier // 2, []
                for piece in window:
                    head, tail = piece.cut(min(need, len(piece.ids)))
                    need -= len(head.ids)
                    if len(head.ids):
                        half.append(head)
                    if len(tail.ids):
                        self.put(tail)
                self.emit(half, tier // 2)
            else:
                for piece in window:
                    self.put(piece)
                return

    def pack(self, force: bool) -> list[tuple]:
        for tier in self.tiers:
            self.fill(tier, force)
        rows, self.rows = self.rows, []
        return rows

    def finish(self) -> list[tuple]:
        """Everything out; what is less than the smallest tier makes the partition's one padded sequence."""
        rows = self.pack(True)
        if self.pool:
            self.emit([self.take(0) for _ in range(len(self.pool))], self.tiers[0])
        return rows + self.pack(True)


def _batches(texts: list) -> Iterator[tuple[int, list[str]]]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > BATCH_CHARS:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(text)
    if len(texts) > start:
        yield start, texts[start:]


def pack(docs: DataFrame, tokenizer_path: str, tiers=TIERS) -> DataFrame:
    """One row per piece of a document in a sequence.

    ``tier`` is the size a sequence is padded to. A document's ids (those of its text, then ``END``) are
    cut where a window ends or a gap needs filling. Each partition packs its own documents as they are
    read, without a shuffle; ids never leave the task. At most one sequence per partition is padded.
    A null text is empty and has only the end id; repeated rows are packed like any others; a null
    doc_id stays null; an empty table gives no rows.
    """
    end = np.array([END], "<u4")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema
        )

    schema = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in names])

    def run(batches):
        from tarnlake.llm.subwords import encoder

        encode, packer = encoder(tokenizer_path), Packer(TaskContext.get().partitionId(), tiers)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            for start, part in _batches(texts):
                for i, tokens in enumerate(encode.text_ids(part)):
                    packer.add(ids[start + i], np.concatenate([tokens, end]))
                if packer.held > HELD_TOKENS:
                    rows = packer.pack(False)
                    rows += packer.pack(True) if packer.held > HELD_TOKENS // 2 else []
                    if rows:
                        yield table(rows, schema)
                elif packer.rows:
                    rows, packer.rows = packer.rows, []
                    yield table(rows, schema)
        rows = packer.finish()
        if rows:
            yield table(rows, schema)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
