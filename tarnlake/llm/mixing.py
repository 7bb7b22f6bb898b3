"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.llm.common import by_place, n_words, running_sums, small
from tarnlake.session import reliable_checkpoint

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """One row per ``_src``: ``source_size``, ``target``.

    Weights repeat along the sources' order. All sizes times ``share`` are dealt by weight; a source
    stops at ``most`` times its size and the rest is dealt again until none is above.
    """
    sources = sizes.groupBy("_src").agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size"), F.lit(1).alias("_one"))
    ranked = running_sums(sources, ["_src"], "_one", "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_weight", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = reliable_checkpoint(ranked.select("_src", "source_size", "_weight"))
    cap = F.lit(float(most)) * F.col("source_size")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, last = 0.0, -1.0
    while level > last:  # the level rises until no further source reaches its cap
        above = cap < F.lit(level) * F.col("_weight")
        full, left = ranked.agg(
            F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_weight")))
        ).first()
        last, level = level, max(level, (total - full) / left if left else level)
    return ranked.select("_src", "source_size", F.least(cap, F.lit(level) * F.col("_weight")).alias("target"))


def _taken(docs: DataFrame, weights, share, most, seed) -> DataFrame:
    """Per distinct (doc_id, source, size): ``_copies`` rows, words before them, epochs and the rest of the last."""
    sizes = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("_src"),  # null sorts last
        n_words(F.col("text")).alias("size"),
    )
    # Repeated rows become one with a count, so no key of theirs fills a task.
    sizes = reliable_checkpoint(sizes.groupBy("doc_id", "_src", "size").agg(F.count("*").alias("_copies")))
    targets = source_targets(sizes, weights, share, most)
    keyed = sizes.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    keyed = keyed.withColumn("_mass", F.col("size") * F.col("_copies"))
    placed = running_sums(keyed, ["_src", "_key", "doc_id", "size"], "_mass", "_start", group="_src")
    placed = placed.join(small(targets), "_src")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    return placed.withColumn("_epochs", epochs).withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST, seed: str = SEED) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken.

    Documents stand in the order of a hash of their id within their source. A source gives whole epochs
    and, of one more, the documents up to its exact budget; the document on the border gives a part.
    A null text has no words, a null source is a source and comes last, an empty table gives no rows.
    Rows alike in doc_id, source and size stand next to each other and are each a document.
    """
    placed = _taken(docs, weights, share, most, seed)
    copies = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    start = F.col("_start") + F.col("_copy") * F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - start))
    return copies.select(
        "doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns unchanged.

    The document on a source's border is taken whole once more, so a source may pass its budget by less
    than one document. Documents without words (null texts too) carry no weight and are left out. Rows
    alike in doc_id, source and size are taken in order of their text. Columns may have any names; an
    empty table gives no rows.
    """
    placed = _taken(docs, weights, share, most, seed).where("size > 0")
    # Copies of the group that the last, partial epoch reaches.
    reached = F.greatest(F.lit(0), F.least(F.col("_copies"), F.ceil((F.col("_rest") - F.col("_start")) / F.col("size"))))
    takes = placed.select(
        F.col("doc_id").alias("_id"), F.col("_src").alias("_s"), F.col("size").alias("_z"), "_copies", "_epochs",
        reached.cast("long").alias("_reached"),
    )
    src = F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))
    inner = by_place(docs, "doc_id", "source", "text")
    found = inner.withColumn("_zz", n_words(F.col("text"))).join(
        takes, F.col("doc_id").eqNullSafe(F.col("_id")) & (src == F.col("_s")) & (F.col("_zz") == F.col("_z"))
    )
    number = F.row_number().over(Window.partitionBy("_id", "_s", "_z").orderBy("text"))
    times = F.col("_epochs") + F.when(number <= F.col("_reached"), 1).otherwise(0)
    found = found.withColumn("_times", times.cast("int")).where("_times > 0")
    return found.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*inner.columns).toDF(*docs.columns)
