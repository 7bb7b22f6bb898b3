"""Content hashes over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text_form(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(value, 6).try_cast("decimal(38,6)").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of the row's columns in name order.

    Every value is written as ``name=length:text``, with length -1 for null, so no two
    different rows share a text form.
    """
    parts = []
    for name in sorted(columns or df.columns):
        text = _text_form(df, name)
        length = F.coalesce(F.length(text), F.lit(-1)).cast("string")
        parts += [F.lit(f"{name}="), length, F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.sha2(F.concat(*parts), 256)
