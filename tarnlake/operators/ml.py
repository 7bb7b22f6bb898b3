"""Training, registry, evaluation and explanation with Spark ML."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnlake.functions.ordered import top_per_key
from tarnlake.operators import binned

SEED = 42
MIN_ROWS = 10
MAX_CLASSES = 20
REGISTRY_SCHEMA = (
    "model_name string, version bigint, artifact_path string, stage string, algorithm string, "
    "feature_names array<string>, target string, created_at timestamp"
)
STAGES = ("development", "staging", "production", "archived")
#: Rows to train on in one task, and rows to explain (each is scored many times).
TRAIN_ROWS, EXPLAIN_ROWS = 50_000, 5_000


def split_rows(df: DataFrame, key: Sequence[str], train_tenths: int = 8):
    """(train, test) by a hash of the key: the same rows on any cluster or partitioning."""
    part = F.pmod(F.xxhash64(*key, F.lit(SEED)), F.lit(10))
    return df.filter(part < train_tenths), df.filter(part >= train_tenths)


def spread(df: DataFrame, rows_per_task: int) -> DataFrame:
    """``df`` dealt evenly to as many tasks as its rows need; a table stored in that many or more stays as it is."""
    tasks = -(-df.count() // rows_per_task)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


def random_forest_regressor(target: str, trees: int = 100, depth: int = 8, min_leaf: int = 1):
    # Each row's node in every tree is kept from level to level, not walked to from the root; the forest is the same.
    return RandomForestRegressor(
        featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, seed=SEED, cacheNodeIds=True,
    )


def gbt_regressor(target: str, rounds: int = 100, depth: int = 4, rate: float = 0.1):
    return GBTRegressor(
        featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=rate,
        seed=SEED,
    )


def random_forest_classifier(trees: int = 100, depth: int = 8):
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED, cacheNodeIds=True
    )


def fit_regression(train: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, estimator]).fit(train)


def fit_classification(
    train: DataFrame, features: Sequence[str], target: str, estimator
) -> PipelineModel:
    """Classes of any type: the index of a class is learnt with the model."""
    indexer = StringIndexer(inputCol=target, outputCol="label", handleInvalid="keep")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[indexer, assembler, estimator]).fit(train)


def _scored(model: PipelineModel, test: DataFrame, label: str) -> DataFrame:
    """Label and prediction of the test rows, kept, for every metric passes over them."""
    return model.transform(test).select(F.col(label).cast("double").alias(label), "prediction").persist()


def regression_metrics(
    model: PipelineModel, test: DataFrame, target: str, names: Sequence[str] = ("r2", "mae", "rmse")
) -> dict[str, float]:
    scored = _scored(model, test, target)
    found = {m: RegressionEvaluator(labelCol=target, metricName=m).evaluate(scored) for m in names}
    scored.unpersist()
    return found


def classification_metrics(
    model: PipelineModel, test: DataFrame, names: Sequence[str] = ("accuracy", "f1")
) -> dict[str, float]:
    scored = _scored(model, test, "label")
    found = {m: MulticlassClassificationEvaluator(labelCol="label", metricName=m).evaluate(scored) for m in names}
    scored.unpersist()
    return found


@dataclass
class Trained:
    model: PipelineModel
    features: list[str]
    target: str
    algorithm: str
    metric_name: str
    metric: float
    rows_trained: int


def train_table(
    df: DataFrame, target: str, key: Sequence[str], algorithm: str = "random_forest"
) -> Trained:
    """Train on a table's numeric columns; classify when the target is a small integer set.

    The key only decides the train/test split and is no feature. From ``binned.COUNTED_ROWS`` training rows on, forests
    for classes and boosted trees for numbers learn from counts of rows alike to a tree, if those are few.
    """
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    kinds = dict(df.dtypes)
    if target not in kinds:
        raise ValueError(f"no column {target!r}; columns: {df.columns}")
    if kinds[target] not in numeric:
        raise ValueError(f"target {target!r} must be numeric")
    features = [c for c, t in df.dtypes if t in numeric and c != target and c not in key]
    if not features:
        raise ValueError("no numeric feature column")
    rows = df.select(*key, *features, target).dropna(subset=[*features, target])
    train, test = split_rows(rows, key)
    total, n_train = rows.count(), train.count()
    if total < MIN_ROWS:
        raise ValueError(f"{total} rows; at least {MIN_ROWS} are needed")
    whole = kinds[target] in numeric[:4]
    classes = rows.select(target).distinct().limit(MAX_CLASSES + 1).count() if whole else 0
    classify = whole and classes <= MAX_CLASSES
    if classify:
        estimator = {
            "random_forest": lambda: random_forest_classifier(),
            "gradient_boosting": lambda: _boosted_classifier(classes),
            "linear": lambda: LogisticRegression(featuresCol="features", labelCol="label"),
        }[algorithm]()
        points = _points(train, features, n_train, estimator, classes) if algorithm == "random_forest" else None
        name = "accuracy"
        if points is None:
            model = fit_classification(train, features, target, estimator)
            value = classification_metrics(model, test, [name])[name]
        else:
            model = binned.fit_forest(train, features, target, points, estimator, classes)
            value = binned.accuracy(model, test)
    else:
        estimator = {
            "random_forest": lambda: random_forest_regressor(target),
            "gradient_boosting": lambda: gbt_regressor(target),
            # Ridge with unit penalty on the sum of squares.
            "linear": lambda: LinearRegression(
                featuresCol="features", labelCol=target, regParam=1.0 / max(n_train, 1),
                elasticNetParam=0.0, standardization=False,
            ),
        }[algorithm]()
        points = _points(train, features, n_train, estimator) if algorithm == "gradient_boosting" else None
        name = "r2_score"
        if points is None:
            model = fit_regression(train, features, estimator)
            value = regression_metrics(model, test, target, ["r2"])["r2"]
        else:
            model = binned.fit_boosted(train, features, points, estimator)
            value = binned.r2(model, test, target)
    return Trained(model, features, target, algorithm, name, round(value, 4), n_train)


def _points(train: DataFrame, features: Sequence[str], n_train: int, estimator, classes: int = 1):
    """Borders of the features' bins where the table is large enough to be learnt from counts, else None."""
    if n_train < binned.COUNTED_ROWS:
        return None
    points = binned.split_points(train, features, estimator.getMaxBins())
    return points if binned.possible_cells(points) * classes * binned.ROWS_PER_CELL <= n_train else None


def _boosted_classifier(classes: int):
    boosted = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=100, maxDepth=3, seed=SEED
    )
    return boosted if classes <= 2 else OneVsRest(classifier=boosted, featuresCol="features")


# --- registry -------------------------------------------------------------------


def save_model(trained: Trained, folder: str, name: str) -> str:
    path = f"{folder}/{name}/v{int(time.time() * 1000)}"
    trained.model.write().overwrite().save(path)
    return path


def register(
    registry: DataFrame, spark: SparkSession, name: str, path: str, trained: Trained, version: int
) -> DataFrame:
    entry = spark.createDataFrame(
        [(name, version, path, STAGES[0], trained.algorithm, trained.features, trained.target)],
        "model_name string, version bigint, artifact_path string, stage string, "
        "algorithm string, feature_names array<string>, target string",
    ).withColumn("created_at", F.current_timestamp())
    return registry.unionByName(entry)


def latest_models(registry: DataFrame, stage: str | None = None) -> DataFrame:
    """The newest entry of every name, in a stage when one is given."""
    held = registry if stage is None else registry.filter(F.col("stage") == stage)
    others = [c for c in held.columns if c != "model_name"]
    newest = F.max_by(F.struct(*others), F.struct("created_at", "version"))
    return held.groupBy("model_name").agg(newest.alias("e")).select("model_name", "e.*")


def promote(registry: DataFrame, name: str, version: int, stage: str) -> DataFrame:
    """Set the stage of one version; an older production version is archived."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    this = (F.col("model_name") == name) & (F.col("version") == version)
    old = (F.col("model_name") == name) & (F.col("version") != version)
    out = F.when(this, stage)
    if stage == "production":
        out = out.when(old & (F.col("stage") == "production"), "archived")
    return registry.withColumn("stage", out.otherwise(F.col("stage")))


def leaderboard(
    runs: DataFrame, lower_is_better: Sequence[str] = (), top: int = 3
) -> DataFrame:
    """Best runs per metric by the last logged value.

    ``runs`` has ``run_id, metric, value, logged_at, step``.
    """
    last = runs.groupBy("metric", "run_id").agg(
        F.max_by("value", F.struct("logged_at", "step")).alias("last_value")
    )
    down = F.col("metric").isin(list(lower_is_better)) if lower_is_better else F.lit(False)
    strength = F.when(down, -F.col("last_value")).otherwise(F.col("last_value"))
    best = top_per_key(
        last.withColumn("_s", strength), ["metric"], [F.desc("_s"), F.asc("run_id")], top
    )
    return best.drop("_s")


# --- evaluation and explanation -------------------------------------------------


def error_report(df: DataFrame, actual: str, predicted: str, key: str) -> DataFrame:
    """One row ``n, mae, rmse, worst, worst_error, best, best_error``; ties go to the lower key."""
    err = F.col(predicted) - F.col(actual)
    scored = df.select(F.col(key).alias("_k"), F.abs(err).alias("_a"), (err * err).alias("_q"))
    return scored.agg(
        F.count("*").alias("n"),
        F.round(F.avg("_a"), 6).alias("mae"),
        F.round(F.sqrt(F.avg("_q")), 6).alias("rmse"),
        F.max_by("_k", F.struct("_a", -F.col("_k"))).alias("worst"),
        F.round(F.max("_a"), 6).alias("worst_error"),
        F.min_by("_k", F.struct("_a", "_k")).alias("best"),
        F.round(F.min("_a"), 6).alias("best_error"),
    )


def group_consistency(df: DataFrame, group: str, predicted: str) -> DataFrame:
    """Per group range and population deviation of predictions, with a verdict."""
    spread = F.max(predicted) - F.min(predicted)
    return (
        df.groupBy(group)
        .agg(
            F.count("*").alias("n"),
            spread.alias("spread"),
            F.round(F.stddev_pop(predicted), 6).alias("std"),
        )
        .filter("n >= 2")
        .withColumn(
            "verdict",
            F.when(F.col("spread") < 0.3, "YES").when(F.col("spread") < 0.6, "PARTIAL").otherwise("NO"),
        )
        .withColumn("spread", F.round("spread", 6))
    )


def feature_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession):
    """``feature, importance, rank, cumulative, near_zero``: one row per feature."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    order = W.orderBy(F.desc("importance"), "feature")
    return df.select(
        "feature",
        "importance",
        F.row_number().over(order).alias("rank"),
        F.sum("importance").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("cumulative"),
        (F.col("importance") < 0.001).alias("near_zero"),
    )


def _predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``model.transform(rows)`` with dense features: trees look up a sparse vector's by search, at every node."""
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    return model.stages[-1].transform(rows.withColumn("features", array_to_vector(vector_to_array("features"))))


def replacement_effects(
    model: PipelineModel,
    rows: DataFrame,
    key: str,
    features: Sequence[str],
    replacements: Mapping[str, float],
) -> DataFrame:
    """``key, feature, base, replaced, effect``: each feature in turn set to its replacement.

    Pass zeros for ablation, medians for contributions. All variants are scored by one
    ``transform``; a row yields one variant per feature.
    """
    names = list(features)
    base = _predicted(model, rows).select(key, *names, F.col("prediction").alias("base"))
    variants = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature"),
                    *[
                        (F.lit(float(replacements[f])) if g == f else F.col(g).cast("double")).alias(g)
                        for g in names
                    ],
                )
                for f in names
            ]
        )
    )
    trial = base.select(key, "base", variants.alias("v")).select(key, "base", "v.*")
    return _predicted(model, trial).select(
        key,
        "feature",
        "base",
        F.col("prediction").alias("replaced"),
        (F.col("base") - F.col("prediction")).alias("effect"),
    )


def sensitivity(
    model: PipelineModel, rows: DataFrame, key: str, feature: str, grid: Sequence[float]
) -> DataFrame:
    """``key, value, prediction`` of every row at every grid value of one feature."""
    values = F.explode(F.array(*[F.lit(float(v)) for v in grid]))
    kept = [c for c in rows.columns if c != feature]
    trial = rows.select(*kept, values.alias(feature))
    return _predicted(model, trial).select(key, F.col(feature).alias("value"), "prediction")


def category_effects(
    model: PipelineModel, rows: DataFrame, flags: Sequence[str], k: int = 5
) -> DataFrame:
    """Mean effect of making every row belong to one category only, strongest up and down.

    ``flags`` are the one-hot columns; the result has ``category, mean_effect, side``.
    """
    names = list(flags)
    base = _predicted(model, rows).withColumnRenamed("prediction", "base")
    kept = [c for c in rows.columns if c not in names]
    variants = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("category"), *[F.lit(int(g == f)).alias(g) for g in names]
                )
                for f in names
            ]
        )
    )
    trial = base.select(*kept, "base", variants.alias("v")).select(*kept, "base", "v.*")
    effects = (
        _predicted(model, trial)
        .groupBy("category")
        .agg(F.avg(F.col("prediction") - F.col("base")).alias("mean_effect"))
    )
    up = effects.orderBy(F.desc("mean_effect"), "category").limit(k).withColumn("side", F.lit("up"))
    down = effects.orderBy("mean_effect", "category").limit(k).withColumn("side", F.lit("down"))
    return up.unionByName(down)
