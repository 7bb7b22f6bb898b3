"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tarnlake.llm.common import by_place
from tarnlake.llm.hashing import HASHED, LOWER, combine, mix, slices, span_hashes, text_bytes, word_places

#: Weights are hashed into so many places.
PLACES = 1 << 18
#: Labelled rows that a model is fitted on at most; the order of a hash of doc_id picks them.
MAX_ROWS = 8192
EPOCHS = 3
#: A document is predicted good from this score on.
CUT = 0.3

ALPHA, BETA, L1, L2 = 0.1, 1.0, 1e-4, 1e-3

#: Byte classes for word shapes: 1 lower case or beyond ASCII, 2 upper case, 3 digit, others themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = 1
SHAPE[65:91] = 2
SHAPE[48:58] = 3


def _shape_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: runs of one byte class count once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    kinds = SHAPE[raw]
    keep = np.zeros(len(raw), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(kinds[keep], before[starts], before[stops])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight places of all texts' n-grams in text order; where each text's begin; a text's factor.

    n-grams: lower-cased words (1, 2) and word shapes (1, 2, 3), a shape noting whether the word repeats
    the one before. An n-gram counts once per occurrence, divided by the root of their number.
    """
    raw, offsets = text_bytes(texts)
    starts, stops, first = word_places(raw, offsets)
    word = span_hashes(LOWER[raw], starts, stops)
    same = np.zeros(len(word), np.uint64)
    same[1:] = word[1:] == word[:-1]
    head = np.zeros(len(word) + 1, bool)
    head[first] = True
    same[head[:-1]] = 0
    shape = mix(_shape_hashes(raw, starts, stops) + same)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes, owners = [], []
    for salt, (units, n) in enumerate([(word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3)]):
        if len(units) < n:
            continue
        grams = combine([units[k : len(units) - n + 1 + k] for k in range(n)])
        whole = text_of[: len(units) - n + 1] == text_of[n - 1 :]
        hashes.append(mix(grams[whole] + np.uint64(salt)))
        owners.append(text_of[: len(units) - n + 1][whole])
    count = len(offsets) - 1
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(count + 1, np.int64), np.ones(count)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    places = (np.concatenate(hashes)[order] % np.uint64(PLACES)).astype(np.int64)
    borders = np.searchsorted(owner[order], np.arange(count + 1))
    return places, borders, 1 / np.sqrt(np.maximum(1, np.diff(borders)))


class Leader:
    """Follow-the-regularised-leader with one step size per weight; place PLACES is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, folds: int = 5) -> bytes:
    """Weights (float32) learned from labelled rows outside fold 0 of crc32(doc_id) mod ``folds``.

    At most ``max_rows`` labelled rows are used, a sample by hash of doc_id and text; one task trains on them.
    Repeated rows count once. Null labels are skipped; a document with several labels counts with the lowest. Without any
    labelled row all weights are 0.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col(label)).cast("double").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.select("_label", "text", F.xxhash64("_id").alias("_o"), "_id", F.xxhash64("text").alias("_t"))
    rows = rows.dropDuplicates(["_id", "_t"]).orderBy("_o", "_id", "_t").limit(max_rows).select("_label", "text", "_o", "_t")

    def train(batches):
        held = []
        for batch in batches:
            for part in slices(batch, "text", HASHED):
                places, borders, factor = features(part.column("text"))
                for i, label in enumerate(part.column("_label").to_pylist()):
                    at, count = np.unique(places[borders[i] : borders[i + 1]], return_counts=True)
                    at, x = np.append(at, PLACES).astype(np.int32), np.append(count * factor[i], 1.0).astype(np.float32)
                    held.append((at, x, label))
        model, dice = Leader(), np.random.default_rng(7)
        for _ in range(EPOCHS):
            for k in dice.permutation(len(held)):
                model.learn(*held[k])
        weights = model.weights(slice(None)).astype("<f4").tobytes()
        yield pa.RecordBatch.from_pydict({"weights": [weights]}, pa.schema([("weights", pa.binary())]))

    fitted = rows.repartition(1).sortWithinPartitions("_o", "_t").mapInArrow(train, "weights binary").first()
    return fitted[0] if fitted else bytes(4 * (PLACES + 1))


def held_out(doc_id: str, folds: int = 5):
    """Rows of fold 0; a null id is in no fold and not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def score(docs: DataFrame, weights: bytes) -> DataFrame:
    """All columns of ``docs`` and ``_score``: the probability of label 1, by sparse dot products.

    Reads the text alone. A null or empty text has the bias for its score.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)  # bounded: PLACES weights
    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType())])

    def run(batches):
        w = np.frombuffer(held.value, "<f4").astype(np.float64)
        for batch in batches:
            for part in slices(batch, "text", HASHED):
                places, borders, factor = features(part.column("text"))
                sums = np.concatenate([[0.0], np.cumsum(w[places])])
                logit = (sums[borders[1:]] - sums[borders[:-1]]) * factor + w[PLACES]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names=[*part.schema.names, "_score"]
                )

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``cut`` on) for every row of ``docs``.

    Null and empty texts have the bias for their score, repeated rows score alike, an empty table gives
    no rows; other columns and their names do not matter.
    """
    plain = docs.select("doc_id", "text")
    scored = score(plain, fit(plain, labels))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= cut).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that the classifier does not reject, columns unchanged, whatever their names.

    Null and empty texts are judged by the bias, repeated rows alike; an empty table gives no rows.
    """
    weights = fit(docs.select("doc_id", "text"), labels)
    return score(by_place(docs, "text"), weights).where(F.col("_score") >= cut).drop("_score").toDF(*docs.columns)
