import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tarnlake.operators import binned, ml
from tests.conftest import rows


def table(spark, n=6000):
    """Few values of ``a`` and ``b``, one value of ``z``, two targets that hang on both with some scatter."""
    noise = F.pmod(F.xxhash64("id"), F.lit(100))
    return spark.range(n, numPartitions=3).select(
        "id",
        (F.col("id") % 11 - 5).cast("int").alias("a"),
        (F.floor(F.col("id") / 7) % 6 * 0.5).alias("b"),
        F.lit(3).alias("z"),
        ((F.col("id") % 11 - 5) * (F.floor(F.col("id") / 7) % 6) + noise / 10.0).alias("y"),
        (((F.col("id") % 11) + (noise > 70).cast("int")) % 3).cast("int").alias("kind"),
    )


FEATURES = ["a", "b", "z"]


def spark_borders(values, bins):
    """The rule of Spark's trees, from the description: the value closest to each stride of the counts ends a bin."""
    values = sorted(values)
    distinct = sorted(set(values))
    if len(distinct) <= bins:
        return [(x + y) / 2 for x, y in zip(distinct, distinct[1:])]
    found, target = [], len(values) / bins
    for low, high in zip(distinct, distinct[1:]):
        upto = [sum(v <= x for v in values) for x in (low, high)]
        if abs(upto[0] - target) < abs(upto[1] - target):
            found.append((low + high) / 2)
            target += len(values) / bins
    return found


@pytest.mark.parametrize("values", [[1.0], [1, 1, 2], list(range(32)), [k * k % 97 for k in range(300)],
                                    [0] * 200 + list(range(60)), list(range(60)) + [60] * 200])
def test_borders_follow_the_rule_of_spark(values):
    counts = {float(v): values.count(v) for v in values}
    assert binned.borders(counts, 32) == spark_borders([float(v) for v in values], 32)


def test_borders_of_extreme_values():
    inf, big = math.inf, 1.7e308
    found = binned.borders({-inf: 1, -big: 1, 1.0: 1, math.nextafter(1.0, 2): 1, big: 1, inf: 1}, 32)
    assert all(math.isfinite(v) for v in found[1:]) and found == sorted(set(found))
    assert found[2] == 1.0 and found[-1] == big


def test_split_points_of_many_values(spark):
    df = spark.range(50_000, numPartitions=4).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("one"))
    many, none = binned.split_points(df, ["x", "one"], 32)
    assert none == [] and len(many) == 31
    assert np.allclose(np.diff([0, *many, 50_000]), 50_000 / 32, atol=120)


def test_a_bin_holds_its_border(spark):
    stages = binned._binning(["x"], [[1.0, 2.5]])
    df = spark.createDataFrame([(v,) for v in (-math.inf, 1.0, 1.0000001, 2.5, 2.6, math.inf)], "x double")
    assert [r["_bin_x"] for r in stages[0].transform(df).collect()] == [0, 0, 1, 1, 2, 2]


def test_boosted_trees_of_counted_rows_are_those_of_the_rows(spark):
    df, estimator = table(spark), ml.gbt_regressor("y", rounds=6, depth=3)
    points = binned.split_points(df, FEATURES, 32)
    counted = binned.fit_boosted(df, FEATURES, points, estimator)
    plain = ml.fit_regression(df, FEATURES, estimator)
    got, want = (dict(rows(m.transform(df).select("id", "prediction"))) for m in (counted, plain))
    assert len(got) == 6000 and got == pytest.approx(want, rel=1e-9)
    assert [t.numNodes for t in counted.stages[-1].trees] == [t.numNodes for t in plain.stages[-1].trees]
    assert binned.r2(counted, df, "y") == pytest.approx(ml.regression_metrics(plain, df, "y", ["r2"])["r2"], rel=1e-9)


def test_r2_of_a_large_mean_and_of_equal_targets(spark):
    df = table(spark, 600).withColumn("y", F.col("y") + 1e9)
    model = binned.fit_boosted(df, FEATURES, binned.split_points(df, FEATURES, 32), ml.gbt_regressor("y", 3, 2))
    assert binned.r2(model, df, "y") == pytest.approx(ml.regression_metrics(model, df, "y", ["r2"])["r2"], rel=1e-6)
    assert binned.r2(model, df.withColumn("y", F.lit(1.0)), "y") == -math.inf
    with pytest.raises(ValueError, match="test rows"):
        binned.r2(model, df.limit(0), "y")


def test_trees_of_counted_rows_are_those_of_the_rows(spark, monkeypatch):
    """With each row drawn once, the forest's trees are those that Spark grows on the rows."""
    df = table(spark)
    monkeypatch.setattr(binned, "drawn", lambda counted, keys, trees, seed: counted.select(
        "*", *[F.col("_rows").cast("double").alias(f"_w{t}") for t in range(trees)]))
    model = binned.fit_forest(
        df, FEATURES, "kind", binned.split_points(df, FEATURES, 32), ml.random_forest_classifier(3, 5), 3
    )
    forest = model.stages[-1]
    assert forest.getNumTrees == 3 and forest.numClasses == 4  # the indexer keeps a class for unknown values
    seeds = np.random.default_rng(ml.SEED).integers(2**62, size=3).tolist()
    for grown, seed in zip(forest.trees, seeds):
        one = ml.random_forest_classifier(1, 5)
        one = one.copy({one.bootstrap: False, one.featureSubsetStrategy: "sqrt", one.seed: seed})
        single = ml.fit_classification(df, FEATURES, "kind", one)
        want = single.stages[-1].trees[0]
        assert (grown.numNodes, grown.depth) == (want.numNodes, want.depth) and want.numNodes > 5
        one_model = PipelineModel([*model.stages[:-1], grown])
        got, want = (rows(m.transform(df).select("id", "prediction")) for m in (one_model, single))
        assert got == want
    score = binned.accuracy(model, df)
    assert score == pytest.approx(ml.classification_metrics(model, df, ["accuracy"])["accuracy"]) and score > 0.4


def test_draws_are_poisson_and_do_not_depend_on_partitions(spark):
    counts = spark.createDataFrame([(k, k % 7 + 1) for k in range(400)], "cell bigint, _rows bigint")
    one = rows(binned.drawn(counts.repartition(1), ["cell"], 50, 42))
    assert one == rows(binned.drawn(counts.repartition(5), ["cell"], 50, 42))
    found = np.array([r[2:] for r in one])
    want = np.array([r[1] for r in one])[:, None]
    assert found.shape == (400, 50) and (found == np.floor(found)).all() and (found >= 0).all()
    spread = (found - want) / np.sqrt(want)
    assert abs(spread.mean()) < 0.03 and abs(spread.var() - 1) < 0.06
    assert abs(np.corrcoef(spread.T)[np.triu_indices(50, 1)]).max() < 0.3 > abs(np.corrcoef(spread)).mean()


def test_large_tables_are_learnt_from_counts(spark, monkeypatch, tmp_path):
    df, forest, boosting = table(spark), ml.random_forest_classifier, ml.gbt_regressor
    monkeypatch.setattr(ml, "random_forest_classifier", lambda: forest(12, 6))
    monkeypatch.setattr(ml, "gbt_regressor", lambda target: boosting(target, rounds=12))
    kept = {a: ml.train_table(df.select("id", *FEATURES, t), t, ["id"], a)
            for a, t in (("random_forest", "kind"), ("gradient_boosting", "y"))}
    monkeypatch.setattr(binned, "COUNTED_ROWS", 1000)
    sizes, boosted, grown = [], ml.GBTRegressor._fit, ml.RandomForestClassifier._fit
    monkeypatch.setattr(ml.GBTRegressor, "_fit", lambda self, d: sizes.append(d.count()) or boosted(self, d))
    monkeypatch.setattr(ml.RandomForestClassifier, "_fit", lambda self, d: sizes.append(d.count()) or grown(self, d))
    for (algorithm, want), target, limit in zip(kept.items(), ("kind", "y"), (66 * 3, 66)):
        sizes.clear()
        done = ml.train_table(df.select("id", *FEATURES, target), target, ["id"], algorithm)
        assert sizes and max(sizes) <= limit
        assert (done.metric_name, done.rows_trained) == (want.metric_name, want.rows_trained)
        assert done.metric == pytest.approx(want.metric, abs=0.02 if target == "kind" else 1e-4)
        assert done.model.stages[-1].getNumTrees == 12
        path = ml.save_model(done, str(tmp_path), algorithm)
        again = PipelineModel.load(path).transform(df).select("id", "prediction")
        assert rows(again) == rows(done.model.transform(df).select("id", "prediction"))


def test_tables_of_many_cells_are_trained_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(binned, "COUNTED_ROWS", 1000)
    df, estimator = table(spark), ml.random_forest_classifier()
    assert len(ml._points(df, FEATURES, 6000, estimator, 3)) == 3
    assert ml._points(df, FEATURES, 999, estimator, 3) is None
    assert ml._points(df.withColumn("z", F.col("id")), FEATURES, 6000, estimator, 3) is None
