"""Line dedup: ranks of line runs by prefix doubling; later copies of repeated runs are deleted.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import by_place, saved

#: Words that a repeated run of lines must have to count.
MIN_WORDS = 20


def _at(column: str, i: Column) -> Column:
    return F.get(F.col(column), i)


def _shifted(column: str, h: int) -> Column:
    """The array from place h on; zipped with the array itself it pads with nulls."""
    return F.slice(column, h + 1, F.greatest(F.lit(0), F.size(column) - h))


def _step(h: int, min_words: int, ahead: bool):
    """Take h more lines if together they still lack words; past the border there is no sum and none is taken."""

    def step(x: Column, i: Column) -> Column:
        at = i + x["m"] if ahead else i - x["m"] - h + 1
        words = x["w"] + F.when(at >= 0, _at(f"s{h}", at))
        fits = words < min_words
        return F.struct(F.when(fits, x["m"] + h).otherwise(x["m"]).alias("m"), F.when(fits, words).otherwise(x["w"]).alias("w"))

    return step


def _runs(docs: DataFrame, min_words: int) -> DataFrame:
    """_id, _h, start, length, run: every shortest run of whole lines with ``min_words`` words.

    The suffixes of a document's line sequence are ranked by their first 1, 2, 4 ... lines: the rank at 2h
    is that of the pair (rank at i, rank at i + h). Two runs of m lines are equal where their two
    overlapping ranks at the largest h <= m are, so equal keys are intervals of the suffix array whose
    common prefix has at least m lines. Runs begin at each line and end at each line; their union covers
    every line of a maximal repeated run.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # Lines without a word stand in no sequence.
    lines = F.filter(
        F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("x"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))),
        lambda s: s["n"] > 0,
    )
    df = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_h"), lines.alias("_l"))
    df = df.select("_id", "_h", F.transform("_l", lambda s: F.xxhash64(s["x"])).alias("r1"), F.transform("_l", lambda s: s["n"]).alias("s1"))
    # A run that lacks a word for each line it has cannot be longer than min_words lines.
    heights = [1]
    while heights[-1] * 2 <= min_words:
        h = heights[-1]
        pair = F.zip_with(f"r{h}", _shifted(f"r{h}", h), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))
        df = df.withColumns({f"r{2 * h}": pair, f"s{2 * h}": F.zip_with(f"s{h}", _shifted(f"s{h}", h), lambda x, y: x + y)})
        heights.append(2 * h)
    df = saved(df, "ranks")  # lambdas below look into these arrays: they must be columns, not expressions
    # Binary descent: the most lines that still lack words, from each line on and back from each line.
    ahead = F.transform("s1", lambda s, i: F.struct(F.lit(0).alias("m"), F.lit(0).alias("w")))
    df = df.withColumn("_a", ahead).withColumn("_z", ahead)
    for h in reversed(heights):
        df = df.withColumns({"_a": F.transform("_a", _step(h, min_words, True)), "_z": F.transform("_z", _step(h, min_words, False))})

    def key(start: Column, m: Column) -> Column:
        out = F.lit(None).cast("long")
        for h in heights:
            out = F.when((m >= h) & (m < 2 * h), F.xxhash64(m, _at(f"r{h}", start), _at(f"r{h}", start + m - h))).otherwise(out)
        return out

    size = F.size("s1")
    forward = F.transform("_a", lambda x, i: F.struct(i.alias("start"), (x["m"] + 1).alias("length")))
    forward = F.filter(forward, lambda r: (r["start"] + r["length"] <= size))
    backward = F.transform("_z", lambda x, i: F.struct((i - x["m"]).alias("start"), (x["m"] + 1).alias("length")))
    backward = F.filter(backward, lambda r: r["start"] >= 0)
    runs = F.array_distinct(F.concat(forward, backward))
    df = df.withColumn("_runs", F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), key(r["start"], r["length"]).alias("run"))))
    return df.select("_id", "_h", F.explode("_runs").alias("r")).select("_id", "_h", "r.*")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _h, start, length: runs of which an equal one stands earlier, by doc_id, then place.

    Lines are counted from 0 among those with a word. Rows alike in doc_id and text are one document.
    """
    runs = saved(_runs(docs, min_words).distinct(), "runs")
    place = F.struct(F.coalesce("_id", F.lit(-(1 << 63)).cast("long")).alias("_id"), "_h", "start")
    firsts = runs.groupBy("run").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = runs.join(firsts, "run").where(place != F.col("_first"))
    return later.select("_id", "_h", "start", "length")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with later copies of repeated line runs deleted, ``_n_lines``, ``_n_deleted``.

    Columns may have any other names; those two are replaced.
    A line is deleted if it lies in a run of consecutive lines with together ``min_words`` words that
    also stands earlier (an earlier document by doc_id, or earlier in the same one). Lines without
    a word are skipped in runs and stay. A null text stays null. Rows alike in doc_id and text are one
    document and keep the same lines; rows without doc_id come first. An empty table gives no rows.
    """
    given = [c for c in docs.columns if c not in ("_n_lines", "_n_deleted")]
    docs = by_place(docs.select(*[f"`{c}`" for c in given]), "doc_id", "text")
    later = repeated_runs(docs.select("doc_id", "text"), min_words)
    gone = later.groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "length")).alias("_gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn("_hash", F.xxhash64(text)).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left"
    )
    marked = marked.withColumn("_lines", F.split(text, "\n", -1))
    numbered = F.transform("_lines", lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i))
    marked = marked.withColumn("_worded", F.array_compact(numbered))
    runs = F.flatten(F.transform("_gone", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    marked = marked.withColumn("_out", F.transform(F.array_distinct(runs), lambda i: _at("_worded", i)))
    rest = F.array_except(F.transform("_lines", lambda x, i: i), F.col("_out"))
    kept = F.array_join(F.transform(rest, lambda i: _at("_lines", i)), "\n")
    n_lines, n_deleted = F.size("_worded").cast("long"), F.coalesce(F.size("_out"), F.lit(0)).cast("long")
    hit = F.col("_gone").isNotNull()
    columns = [F.when(hit, kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return marked.select(
        *columns, n_lines.alias("_n_lines"), F.when(hit, n_deleted).otherwise(F.lit(0).cast("long")).alias("_n_deleted")
    ).toDF(*given, "_n_lines", "_n_deleted")


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs deleted; a document that loses all its lines goes; n_chars follows the text.

    Null texts and texts without lines stay; rows alike in doc_id and text keep the same lines; other
    columns may have any names. An empty table gives no rows.
    """
    inner = by_place(docs, "doc_id", "text", "n_chars")
    df = dedup_lines(inner, min_words).where("_n_deleted = 0 or _n_deleted < _n_lines")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        df = df.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return df.select(*inner.columns).toDF(*docs.columns)
