import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions.scoring import decade, ladder
from tarnlake.operators import drift, features, ml
from tarnlake.plans import load_all
from tarnlake.plans.registry import QUERIES

from .conftest import rows

load_all()


def sided(spark, ref, cur):
    return spark.createDataFrame(
        [(v, True) for v in ref] + [(v, False) for v in cur], "x double, is_reference boolean"
    )


def brute_psi(ref, cur, bins=10, eps=1e-6):
    ref, cur = [v for v in ref if v is not None], [v for v in cur if v is not None]
    low, high = min(ref), max(ref)
    width = (high - low) / bins

    def shares(values):
        counts = [0] * bins
        for v in values:
            b = 0 if width == 0 else min(max(math.floor((v - low) / width), 0), bins - 1)
            counts[b] += 1
        return [c / len(values) + eps for c in counts]

    return sum((c - r) * math.log(c / r) for r, c in zip(shares(ref), shares(cur)))


@pytest.mark.parametrize(
    "ref,cur",
    [
        (list(range(100)), list(range(50, 150))),
        (list(range(100)), list(range(100))),
        ([1, 2, None, 3], [None, -5, 99]),
        ([7, 7, 7], [7, 8, 9]),
    ],
)
def test_psi_matches_brute_force(spark, ref, cur):
    as_float = [[None if v is None else float(v) for v in side] for side in (ref, cur)]
    got = drift.psi(sided(spark, *as_float), ["x"]).first()
    assert got["psi"] == pytest.approx(brute_psi(*as_float), abs=1e-4)
    assert got["drift_detected"] == (brute_psi(*as_float) > 0.15)


def test_severity_bands(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.3,)], "p double")
    assert [r[0] for r in df.select(drift.severity(F.col("p"))).collect()] == ["ok", "warn", "critical"]


def test_halves(spark):
    df = drift.half_flag(spark.range(11), "id")
    assert df.filter("is_reference").count() == 6


def test_anomalies_need_spread(spark):
    flat = spark.createDataFrame([(i, 5.0) for i in range(9)], "id int, v double")
    assert drift.zscore_anomalies(flat, "v", ["id"]).count() == 0
    assert drift.zscore_anomalies(flat.limit(1), "v", ["id"]).count() == 0
    assert drift.zscore_anomalies(flat.limit(0), "v", ["id"]).count() == 0
    spiked = flat.unionByName(spark.createDataFrame([(i, 5.0) for i in range(20, 40)] + [(99, 500.0)], flat.schema))
    got = drift.zscore_anomalies(spiked, "v", ["id"]).collect()
    assert [r["id"] for r in got] == [99] and got[0]["z_score"] > 3


def test_feature_preparation_and_sampling(spark, partitions):
    df = spark.createDataFrame([(1, None)], "k int, a int")
    assert rows(features.prepare_features(df, ["a", "b"], ["k"])) == [(1, 0.0, 0.0)]
    picks = []
    for _ in partitions():
        picks.append(rows(features.sample_rows(spark.range(500).repartition(7), ["id"], 20)))
    assert picks[0] == picks[1] and len(picks[0]) == 20


def test_missing_features(spark):
    need = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a")], "model string, feature string")
    have = spark.createDataFrame([("a",)], "feature string")
    got = features.missing_features(need, have).select("model", "missing", "status")
    assert rows(got) == [("m", 1, "warn"), ("n", 0, "ok")]


def test_scoring(spark):
    df = spark.createDataFrame([(1994, 7.0), (2000, 3.0)], "y int, v double")
    got = df.select(decade(F.col("y")), ladder(F.col("v"), [(8, "a"), (5, "b")], "c"))
    assert rows(got) == [(1990, "b"), (2000, "c")]


# --- models ---------------------------------------------------------------------


def line(spark, n=200):
    return spark.range(n).selectExpr("id", "id / 100.0D AS x", "3 * id / 100.0D + 1 AS y", "id % 2 AS parity")


def test_train_table_regression_and_classes(spark):
    df = line(spark).drop("parity")
    done = ml.train_table(df, "y", ["id"], "linear")
    assert done.metric_name == "r2_score" and done.metric > 0.99 and done.features == ["x"]
    flags = line(spark).selectExpr("id", "x", "CAST(x > 1 AS INT) AS big")
    done = ml.train_table(flags, "big", ["id"], "random_forest")
    assert done.metric_name == "accuracy" and done.metric > 0.9


def test_train_table_refuses(spark):
    with pytest.raises(ValueError, match="rows"):
        ml.train_table(line(spark, 5), "y", ["id"], "linear")
    with pytest.raises(ValueError, match="no column"):
        ml.train_table(line(spark), "z", ["id"])
    with pytest.raises(ValueError, match="numeric"):
        ml.train_table(line(spark).withColumn("s", F.lit("a")), "s", ["id"])


def test_split_does_not_depend_on_partitions(spark):
    one = rows(ml.split_rows(spark.range(300).repartition(1), ["id"])[0])
    many = rows(ml.split_rows(spark.range(300).repartition(9), ["id"])[0])
    assert one == many and 200 < len(one) < 280


def test_registry_promotion(spark):
    done = ml.Trained(None, ["x"], "y", "linear", "r2", 1.0, 5)
    registry = spark.createDataFrame([], ml.REGISTRY_SCHEMA)
    for version in (1, 2):
        registry = ml.register(registry, spark, "m", f"/m/{version}", done, version)
    registry = ml.promote(registry, "m", 1, "production")
    registry = ml.promote(registry, "m", 2, "production")
    assert rows(registry.select("version", "stage")) == [(1, "archived"), (2, "production")]
    assert ml.latest_models(registry).first()["version"] == 2
    with pytest.raises(ValueError):
        ml.promote(registry, "m", 1, "moon")


def test_leaderboard_direction(spark):
    runs = spark.createDataFrame(
        [("r1", "rmse", 0.9, 1, 1), ("r1", "rmse", 0.5, 2, 2), ("r2", "rmse", 0.7, 1, 1), ("r1", "acc", 0.1, 1, 1)],
        "run_id string, metric string, value double, logged_at int, step int",
    )
    best = {r["metric"]: r["run_id"] for r in ml.leaderboard(runs, ["rmse"], 1).collect()}
    assert best == {"rmse": "r1", "acc": "r1"}


def test_explanations(spark):
    df = line(spark).withColumn("noise", F.lit(0.0))
    model = ml.fit_regression(df, ["x", "noise"], ml.random_forest_regressor("y", trees=5, depth=4))
    importance = ml.feature_importance(model, ["x", "noise"], spark).collect()
    assert importance[0]["feature"] == "x" and importance[-1]["near_zero"]
    assert importance[-1]["cumulative"] == pytest.approx(1.0)
    effects = ml.replacement_effects(model, df, "id", ["x", "noise"], {"x": 0.0, "noise": 0.0})
    assert effects.count() == 400
    assert effects.filter("feature = 'noise' AND effect <> 0").count() == 0
    scan = ml.sensitivity(model, df, "id", "x", [0.0, 1.0])
    assert scan.count() == 400



def test_forests_keep_node_ids_and_are_the_same(spark):
    df = line(spark, 200).withColumn("noise", F.col("id") % 3)
    forest = ml.random_forest_regressor("y", trees=5, depth=4)
    assert forest.getCacheNodeIds() and ml.random_forest_classifier().getCacheNodeIds()
    kept = ml.fit_regression(df, ["x", "noise"], forest).stages[-1]
    walked = ml.fit_regression(df, ["x", "noise"], forest.copy({forest.cacheNodeIds: False})).stages[-1]
    assert [t.toDebugString.split("\n")[1:] for t in kept.trees] == [t.toDebugString.split("\n")[1:] for t in walked.trees]


def test_explained_rows_are_dense_and_predicted_alike(spark):
    df = line(spark, 50).withColumns({f"f{k}": (F.col("id") % 9 == k).cast("int") for k in range(8)})
    names = ["x", *[f"f{k}" for k in range(8)]]
    model = ml.fit_regression(df, names, ml.random_forest_regressor("y", trees=5, depth=4))
    got = ml._predicted(model, df)
    assert {type(r["features"]).__name__ for r in got.select("features").collect()} == {"DenseVector"}
    assert rows(got.select("id", "prediction")) == rows(model.transform(df).select("id", "prediction"))


def test_spread_deals_only_tables_stored_in_too_few_tasks(spark):
    df = spark.range(95, numPartitions=2)
    assert ml.spread(df, 10).rdd.getNumPartitions() == 10 and rows(ml.spread(df, 10)) == rows(df)
    assert ml.spread(df, 60).rdd.getNumPartitions() == 2
    assert ml.spread(spark.range(0), 10).count() == 0


def test_category_effects(spark):
    df = spark.range(100).selectExpr("id", "CAST(id % 2 = 0 AS INT) AS a", "CAST(id % 2 = 1 AS INT) AS b",
                                     "CAST(id % 2 AS DOUBLE) * 10 AS y")
    model = ml.fit_regression(df, ["a", "b"], ml.random_forest_regressor("y", trees=5, depth=3))
    got = {(r["category"], r["side"]): r["mean_effect"] for r in ml.category_effects(model, df, ["a", "b"], 1).collect()}
    assert got[("b", "up")] > 0 > got[("a", "down")]


def test_churn_gate_keeps_customers_without_orders(spark, tmp_path, monkeypatch):
    sf = "/root/testdata/sf0.001"
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet").filter("o_custkey % 4 <> 0")
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    seen, split = [], ml.split_rows
    monkeypatch.setattr(ml, "split_rows", lambda df, key: seen.append(df) or split(df, key))
    assert QUERIES["ml_churn_gate"](spark, str(tmp_path)).count() == 3
    got = {r["c_custkey"]: (r["orders"], float(r["spent"]), r["churned"]) for r in seen[0].collect()}
    none = {r[0] for r in customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey").collect()}
    assert len(got) == customer.count() and none
    assert {got[k] for k in none} == {(0, 0.0, 1)}
    assert all(v[0] > 0 for k, v in got.items() if k not in none)


def test_train_metrics_run_all_algorithms(spark):
    got = QUERIES["ml_train_metrics"](spark, "/root/testdata/sf0.001").collect()
    assert {r["algorithm"] for r in got} == {"random_forest", "gradient_boosting", "linear"}
    assert all(np.isfinite(r["value"]) and r["rows_trained"] > 0 for r in got)
