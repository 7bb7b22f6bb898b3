"""Documents to packed training sequences, in five stages; each is written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.common import read, saved
from tarnlake.llm.line_dedup import without_copies
from tarnlake.llm.mixing import mixed_documents
from tarnlake.llm.ngram_join import one_of_each
from tarnlake.llm.packing import pack
from tarnlake.llm.quality_model import accepted
from tarnlake.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    prepare(spark)
    return accepted(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs."""
    prepare(spark)
    return without_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    prepare(spark)
    return one_of_each(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight takes them."""
    prepare(spark)
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    prepare(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packed", packed),
]

#: No stage but the mixture can be said in SQL. Tests hold the operators of lines, near_duplicates, mixture and packed
#: against brute force; which documents the quality stage rejects, the chain of stages and ``run`` are not tested.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
