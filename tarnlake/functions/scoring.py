"""Score and bucket expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_rating(votes: Column, rating: Column, m: float, c: float, digits: int = 4) -> Column:
    """Mean rating pulled towards the prior ``c`` with the weight of ``m`` votes."""
    return F.round((votes * rating + F.lit(m) * F.lit(c)) / (votes + F.lit(m)), digits)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def ladder(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower limit the value reaches; ``steps`` run from high to low."""
    out = None
    for limit, label in steps:
        out = F.when(value >= limit, label) if out is None else out.when(value >= limit, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def contains_flags(text: Column, words: Sequence[str], prefix: str) -> list[Column]:
    """One 0/1 column per word, 1 where the word occurs in the text."""
    return [text.contains(w).cast("int").alias(f"{prefix}{w.lower()}") for w in words]
