"""Trees of large tables, learnt from counted rows.

A tree of Spark ML sees a number only by its bin, one of at most 32. Rows that share the bins of all their features are
one cell, and no split tells them apart, so their counts, and for a squared error their mean, say all that the tree
learns from them. Training then reads as many rows as there are cells, whatever the size of the table.

* ``fit_boosted``: rounds of squared error add up over a cell, so the trees are those of the single rows (up to the
  rounding of sums): split gains do not depend on how a cell's targets scatter around their mean.
* ``fit_forest``: a bootstrap gives each row a Poisson(1) weight per tree. The weights of n rows alike sum to a
  Poisson(n) number, drawn here once per cell, class and tree from a seed of the cell: the draws do not depend on
  how rows are partitioned (those of Spark do), but they are not the ones that Spark makes row by row.

A bootstrap of a regression also depends on the single targets of a cell, so regression forests are not learnt this way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables of fewer training rows, or fewer per possible cell, are trained row by row.
COUNTED_ROWS, ROWS_PER_CELL = 200_000, 10
#: Features of at most about so many values are cut by their exact counts, others by so many evenly spaced ranks.
VALUES, RANKS = 1_000, 1_000
#: Cells to train on in one task, and trees grown at the same time.
CELL_ROWS, THREADS = 50_000, 8


def borders(counts: Mapping[float, int], bins: int) -> list[float]:
    """At most ``bins - 1`` borders between values, as Spark chooses them: the left bin holds its border."""
    values = sorted(counts)
    cuts = range(1, len(values))
    if len(values) > bins:
        stride = target = sum(counts.values()) / bins
        cuts, seen = [], counts[values[0]]
        for k in range(1, len(values)):
            before, seen = seen, seen + counts[values[k]]
            if abs(before - target) < abs(seen - target):
                cuts.append(k)
                target += stride
    return [_between(values[k - 1], values[k]) for k in cuts]


def _between(low: float, high: float) -> float:
    """The middle, or ``low`` where that is infinite or rounds to ``high``."""
    middle = low / 2 + high / 2
    return middle if low <= middle < high else low


def split_points(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Borders of the bins of each feature, from all rows."""
    numbers = df.select(*[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(features)])
    names = numbers.columns
    distinct = numbers.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first().asDict()
    few = [c for c in names if distinct[c] <= VALUES]
    counts: dict[str, dict[float, int]] = {c: {} for c in names}
    if few:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in few])).alias("p")
        for r in numbers.select(pairs).groupBy("p.f", "p.v").count().collect():
            counts[r["f"]][r["v"]] = r["count"]
    many = [c for c in names if c not in few]
    if many:
        ranks = ", ".join(f"{(k + 0.5) / RANKS}D" for k in range(RANKS))
        found = numbers.agg(*[F.expr(f"percentile_approx({c}, array({ranks}), 10000)").alias(c) for c in many]).first()
        for c in many:
            for v in found[c]:
                counts[c][v] = counts[c].get(v, 0) + 1
    return [borders(counts[c], bins) for c in names]


def possible_cells(points: Sequence[Sequence[float]]) -> int:
    return math.prod(len(p) + 1 for p in points)


def _binning(features: Sequence[str], points: Sequence[Sequence[float]]):
    """Stages from numbers to a vector of their bins, and the names of the bins."""
    names = [f"_bin_{c}" for c in features]
    # A bucket starts at its border, a bin ends with it.
    edges = [[-math.inf, *[math.nextafter(p, math.inf) for p in found or [0.0]], math.inf] for found in points]
    buckets = Bucketizer(splitsArray=edges, inputCols=list(features), outputCols=names)
    return buckets, VectorAssembler(inputCols=names, outputCol="features"), names


def _cells(counted: DataFrame, names: Sequence[str], assembler: VectorAssembler, bound: int, keep) -> DataFrame:
    """Kept rows for training: bins are numbers (the buckets say that they are categories)."""
    numbers = [F.col(c).alias(c, metadata={}) for c in names]
    few = counted.coalesce(-(-bound // CELL_ROWS)).select(*numbers, *keep)
    return assembler.transform(few).select("features", *keep).persist()


def _bins_for(estimator, bound: int) -> int:
    """So many bins that Spark looks for splits in all cells, not in a sample; the bins themselves are given."""
    return max(estimator.getMaxBins(), math.isqrt(bound) + 1)


def fit_boosted(
    train: DataFrame, features: Sequence[str], points: Sequence[Sequence[float]], estimator: GBTRegressor
) -> PipelineModel:
    """Boosted trees for a squared error, from rows and mean target of each cell."""
    target, bound = estimator.getLabelCol(), possible_cells(points)
    buckets, assembler, names = _binning(features, points)
    counted = buckets.transform(train).groupBy(*names).agg(
        F.count("*").cast("double").alias("_rows"), F.avg(target).alias(target)
    )
    cells = _cells(counted, names, assembler, bound, ["_rows", target])
    counts = {estimator.weightCol: "_rows", estimator.maxBins: _bins_for(estimator, bound)}
    model = estimator.fit(cells, counts)
    cells.unpersist()
    return PipelineModel([buckets, assembler, model])


def drawn(counted: DataFrame, keys: Sequence[str], trees: int, seed: int) -> DataFrame:
    """``counted`` with the weights ``_w0, _w1, ...`` of each row in each tree's bootstrap, for its ``_rows`` rows."""
    names, weights = counted.columns, [f"_w{t}" for t in range(trees)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column("_seed").to_numpy().view(np.uint64)
            rows = batch.column("_rows").to_numpy()
            found = np.empty((len(rows), trees))
            for i, (s, n) in enumerate(zip(seeds, rows, strict=True)):
                found[i] = np.random.default_rng([seed, int(s)]).poisson(n, trees)
            columns = [*[batch.column(c) for c in names], *[pa.array(np.ascontiguousarray(found[:, t])) for t in range(trees)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *weights])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in counted.dtypes], *[f"{w} double" for w in weights]])
    return counted.withColumn("_seed", F.xxhash64(*keys)).mapInArrow(draw, schema)


def fit_forest(
    train: DataFrame, features: Sequence[str], target: str, points: Sequence[Sequence[float]],
    estimator: RandomForestClassifier, classes: int,
) -> PipelineModel:
    """A forest of bootstrapped trees, from the rows of each cell and class."""
    bound, trees, seed = possible_cells(points) * classes, estimator.getNumTrees(), estimator.getSeed()
    indexer = StringIndexer(inputCol=target, outputCol="label", handleInvalid="keep").fit(train)
    buckets, assembler, names = _binning(features, points)
    rows = buckets.transform(indexer.transform(train))
    counted = rows.groupBy(*names, "label").agg(F.count("*").alias("_rows"))
    # What the indexer says of the label tells the trees the number of classes.
    label = F.col("label").alias("label", metadata=rows.schema["label"].metadata)
    weighted = drawn(counted, [*names, "label"], trees, seed)
    weights = [f"_w{t}" for t in range(trees)]
    cells = _cells(weighted.withColumn("label", label), names, assembler, bound, ["label", *weights])
    subset = estimator.getFeatureSubsetStrategy()
    single = estimator.copy({
        estimator.numTrees: 1, estimator.bootstrap: False, estimator.cacheNodeIds: False,
        estimator.featureSubsetStrategy: ("sqrt" if trees > 1 else "all") if subset == "auto" else subset,
        estimator.maxBins: _bins_for(estimator, bound),
    })
    cells.count()
    seeds = np.random.default_rng(seed).integers(2**62, size=trees).tolist()
    grown = single.fitMultiple(cells, [{single.weightCol: w, single.seed: s} for w, s in zip(weights, seeds, strict=True)])
    with ThreadPool(min(THREADS, trees)) as pool:
        one = inheritable_thread_target(train.sparkSession)(lambda _: next(grown))
        found = dict(pool.imap_unordered(one, range(trees)))
    cells.unpersist()
    return PipelineModel([indexer, buckets, assembler, _forest([found[t] for t in range(trees)], estimator)])


def _forest(
    singles: Sequence[RandomForestClassificationModel], estimator: RandomForestClassifier
) -> RandomForestClassificationModel:
    """One forest of the trees of several."""
    first, sc = singles[0]._java_obj, SparkContext._active_spark_context
    package = sc._jvm.org.apache.spark.ml.classification
    trees = sc._gateway.new_array(package.DecisionTreeClassificationModel, len(singles))
    for t, single in enumerate(singles):
        trees[t] = single.trees[0]._java_obj
    joined = package.RandomForestClassificationModel(estimator.uid, trees, first.numFeatures(), first.numClasses())
    model = estimator._copyValues(RandomForestClassificationModel(joined))
    model._transfer_params_to_java()
    return model


# --- metrics --------------------------------------------------------------------


def _scored(model: PipelineModel, test: DataFrame, by: Sequence[str], *sums: Column) -> DataFrame:
    """Each cell of the test rows once, with its prediction and what ``sums`` say of its rows, kept."""
    *before, assembler, trees = model.stages
    cells = PipelineModel(before).transform(test).groupBy(*assembler.getInputCols(), *by).agg(*sums)
    scored = trees.transform(assembler.transform(cells))
    return scored.drop(*assembler.getInputCols(), "features", "rawPrediction", "probability").persist()


def accuracy(model: PipelineModel, test: DataFrame) -> float:
    """Share of the test rows whose class ``fit_forest``'s model predicts."""
    scored = _scored(model, test, ["label"], F.count("*").cast("double").alias("_rows"))
    found = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy", weightCol="_rows")
    value = found.evaluate(scored)
    scored.unpersist()
    return value


def r2(model: PipelineModel, test: DataFrame, target: str) -> float:
    """R squared of ``fit_boosted``'s model over the test rows.

    Squares are taken around the mean of each cell, so a large mean of all does not drown them.
    """
    y = F.col(target).cast("double")
    scored = _scored(
        model, test, [], F.count("*").alias("n"), F.avg(y).alias("m"), (F.count("*") * F.var_pop(y)).alias("s")
    )
    n, mean = scored.agg(F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")).first()
    if not n:
        raise ValueError("no test rows")

    def squares(around: Column) -> Column:
        return F.sum(F.col("s") + F.col("n") * (F.col("m") - around) ** 2)

    missed, total = scored.agg(squares(F.col("prediction")), squares(F.lit(mean))).first()
    scored.unpersist()
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(1 - np.float64(missed) / np.float64(total))
