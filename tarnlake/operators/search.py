"""Keyword search by scan or by a stored term index, rank fusion and reranking."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.text import spaced_words, term_count, word_count
from tarnlake.session import reliable_checkpoint
from tarnlake.sources.tables import Lakehouse, bucket_of

K1, B = 1.2, 0.75
RRF_K = 60


def query_terms(text: str) -> list[str]:
    """Distinct terms of a query, in first-seen order, by the rule of ``spaced_words``."""
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower())
    return list(dict.fromkeys(words.split()))


def _add(columns: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, columns)


def bm25(df: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """``id, score, matched`` of every document that holds a query term.

    The texts are read once, into one small row of counts per document that is kept in
    the checkpoint folder. Collection statistics (size, mean length, document frequency
    of each term) are one aggregate over those rows. Nothing is exploded or joined.
    """
    terms = query_terms(query)
    if not terms:
        raise ValueError("the query holds no term")
    spaced = df.select(id_col, text_col).select(
        id_col, spaced_words(F.col(text_col)).alias("_t")
    )
    counted = reliable_checkpoint(
        spaced.select(
            id_col,
            word_count(F.col("_t")).alias("_len"),
            *[term_count(F.col("_t"), term).alias(f"_tf{i}") for i, term in enumerate(terms)],
        )
    )
    hits = [F.col(f"_tf{i}") > 0 for i in range(len(terms))]
    stats = counted.agg(
        F.struct(
            F.count("*").alias("n"),
            F.avg("_len").alias("mean_len"),
            *[F.count_if(h).alias(f"df{i}") for i, h in enumerate(hits)],
        ).alias("s")
    )
    matched = _add([h.cast("int") for h in hits])
    found = counted.filter(matched > 0).withColumn("_s", stats.scalar())
    kept = F.col("_s")
    score = _score([(F.col(f"_tf{i}"), kept[f"df{i}"]) for i in range(len(terms))], F.col("_len"), kept["n"], kept["mean_len"])
    return found.select(id_col, score.alias("score"), matched.alias("matched"))


def _score(terms: Sequence[tuple[Column, Column]], length: Column, n: Column, mean_len: Column) -> Column:
    """BM25 from each term's count in the document and in how many documents it stands."""
    parts = []
    for tf, freq in terms:
        idf = F.ln(1 + (n - freq + 0.5) / (freq + 0.5))
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_len)))
    return F.round(_add(parts), 6)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, row, len, term, tf`` for every distinct word of each row ``id, row, words``."""
    for batch in batches:
        for n in range(0, batch.num_rows, 256):
            part = batch.slice(n, 256)
            words = part.column("words")
            pairs = pa.table({"i": pc.list_parent_indices(words), "term": pc.list_flatten(words)})
            found = pairs.group_by(["i", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            for rows in found.to_batches():
                at = rows.column("i")
                columns = [
                    part.column("id").take(at), part.column("row").take(at),
                    pc.list_value_length(words).take(at).cast(pa.int32()),
                    rows.column("term").cast(pa.string()), rows.column("count_all").cast(pa.int32()),
                ]
                yield pa.record_batch(columns, ["id", "row", "len", "term", "tf"])


class TermIndex:
    """Postings of a text collection, kept in a lakehouse and added to batch by batch.

    ``{name}_postings`` holds term, id, the term's count and the document's length, in buckets of the
    term and sorted by it; ``{name}_sizes`` holds documents and words of every batch. A search opens the
    buckets of its terms and skips the row groups of others. Each row added is a document of its own;
    a null text is a document that has no part in the mean length.
    """

    def __init__(self, lake: Lakehouse, name: str, buckets: int = 64):
        self.lake, self.spark = lake, lake.spark
        self.postings, self.sizes = lake.key(f"{name}_postings"), lake.key(f"{name}_sizes")
        self.buckets = buckets

    def add(self, df: DataFrame, id_col: str, text_col: str) -> None:
        """Take in documents; they are found once all their postings are written."""
        with self.lake.batch() as batch:
            n = (batch.entry(self.postings).buckets if batch.entry(self.postings) else 0) or self.buckets
            words = F.filter(F.split(spaced_words(F.col(text_col)), " "), lambda w: w != "")
            docs = df.select(
                F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words.alias("words")
            )
            # Counted inside each row, for that takes no shuffle; then sent to its term's bucket. Large buckets span several files.
            # Counted inside each row, for that takes no shuffle; then sent to its term's bucket. Large buckets span several files.
            kind = docs.schema["id"].dataType.simpleString()
            counts = docs.mapInArrow(_term_counts, f"id {kind}, row bigint, len int, term string, tf int")
            parts = batch.stage_buckets(counts.withColumn("batch", F.lit(batch.number)), self.postings, bucket_of(["term"], n), sort=["term"])
            held = batch.entry(self.postings)
            batch.put(self.postings, [*(held.parts if held else ()), *parts], buckets=n, key=("term",))
            length = F.when(F.col("words").isNotNull(), F.size("words"))
            sizes = docs.agg(F.count("*").alias("docs"), F.count("words").alias("texts"), F.coalesce(F.sum(length), F.lit(0)).alias("words"))
            batch.add(self.sizes, batch.stage(sizes, self.sizes))

    def _parts(self, terms: Sequence[str]):
        held = self.lake.manifest().tables[self.postings]
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        hit = {r[0] for r in asked.select(bucket_of(["term"], held.buckets)).collect()}
        return [p for p in held.parts if p.bucket in hit]

    def search(self, query: str, id_col: str = "id") -> DataFrame:
        """``id, score, matched`` of every document that holds a query term, as ``bm25`` has it."""
        terms = query_terms(query)
        if not terms:
            raise ValueError("the query holds no term")
        parts = self._parts(terms)
        sizes = self.lake.read(self.sizes.split("/", 1)[1], self.sizes.split("/", 1)[0])
        n, texts, words = sizes.agg(F.sum("docs"), F.sum("texts"), F.sum("words")).first()
        if not parts:
            return sizes.select(F.lit(0).cast("long").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("matched")).limit(0)
        postings = self.spark.read.parquet(*[f"{self.lake.root}/{p.path}" for p in parts]).filter(F.col("term").isin(terms))
        # One count per query term.
        freq = dict(postings.groupBy("term").count().collect())
        per_doc = postings.groupBy("batch", "row", "id", "len").agg(
            *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)],
            F.count("*").cast("int").alias("matched"),
        )
        pairs = [(F.col(f"tf{i}"), F.lit(freq.get(t, 0))) for i, t in enumerate(terms)]
        score = _score(pairs, F.col("len"), F.lit(n), F.lit(words / texts))
        return per_doc.select(F.col("id").alias(id_col), score.alias("score"), "matched")


def best(scored: DataFrame, id_col: str, k: int, by: Sequence[str] = ("score",)) -> DataFrame:
    return scored.orderBy(*[F.desc(c) for c in by], id_col).limit(k)


def _ranked(top: DataFrame, id_col: str, name: str, depth: int) -> DataFrame:
    """Ranks of a list that is already cut to ``depth`` rows, so it fits one small array."""
    rows = top.orderBy(F.desc("score"), id_col).limit(depth)
    packed = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"),
                                                           F.col(id_col).alias("id")))).alias("l"))
    return packed.select(F.posexplode("l").alias("p", "e")).select(
        F.col("e.id").alias(id_col), (F.col("p") + 1).alias(name)
    )


def fuse_ranks(lists: Sequence[DataFrame], id_col: str, depth: int = 50, k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of ``id, score`` lists: ``id, rrf`` of the best ``k``."""
    ranked = [_ranked(top, id_col, f"_r{i}", depth) for i, top in enumerate(lists)]
    joined = functools.reduce(lambda a, b: a.join(b, id_col, "full"), ranked)
    shares = [
        F.coalesce(F.lit(1.0) / (RRF_K + F.col(f"_r{i}")), F.lit(0.0)) for i in range(len(lists))
    ]
    return joined.select(id_col, F.round(_add(shares), 8).alias("rrf")).orderBy(
        F.desc("rrf"), id_col
    ).limit(k)


def rerank(candidates: DataFrame, id_col: str, terms: int, k: int) -> DataFrame:
    """Candidates ordered by the share of query terms they hold, then by their score."""
    covered = candidates.withColumn("coverage", F.round(F.col("matched") / F.lit(terms), 6))
    return best(covered, id_col, k, by=("coverage", "score"))
