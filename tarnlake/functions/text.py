"""Words and chunks of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spaced_words(text: Column) -> Column:
    """The lower-case ASCII words of the whole text in one string.

    Two spaces stand between words and one at each end, so a word owns the spaces beside
    it. Counting in this form is a plain substring search, far cheaper than walking arrays.
    """
    words = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "  "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def _shrink(spaced: Column, part: str) -> Column:
    return F.length(spaced) - F.length(F.replace(spaced, F.lit(part), F.lit("")))


def word_count(spaced: Column) -> Column:
    gaps = (_shrink(spaced, "  ") / 2).cast("int")
    return F.when(spaced == "  ", 0).otherwise(gaps + 1)


def term_count(spaced: Column, term: str) -> Column:
    """Occurrences of one word; the spaces around it are its own."""
    return (_shrink(spaced, f" {term} ") / (len(term) + 2)).cast("int")


def chunk_text(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_no`` from 0, and ``chunk``.

    Chunks start every ``size - overlap`` characters and the last one reaches the end;
    an empty text has none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than the size")
    step = size - overlap
    length = F.length(text)
    last = F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int")
    numbers = F.when(length > 0, F.sequence(F.lit(0), last))
    kept = [c for c in df.columns if c != text]
    numbered = df.select(*kept, text, F.explode(numbers).alias("chunk_no"))
    chunk = F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size))
    return numbered.select(*kept, "chunk_no", chunk.alias("chunk"))
