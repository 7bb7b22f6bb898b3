"""Drift, anomalies, features, models."""

from __future__ import annotations

import functools

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tarnlake.operators import drift, features, ml
from tarnlake.plans.golden import BRANDS, TYPES, part_features
from tarnlake.plans.registry import query, table
from tarnlake.session import scratch_path
from tarnlake.sources.tables import Lakehouse

DRIFT_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _psi_sql(table_name: str, columns: list[str], order: str, threshold: float) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, ref, CAST({c} AS DOUBLE) AS x FROM sided" for c in columns
    )
    return f"""
    WITH sided AS (
      SELECT *, {order} <= (SELECT quantile_disc({order}, 0.5) FROM {table_name}) AS ref
      FROM {table_name}),
    long AS ({cells}),
    lim AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM long WHERE ref GROUP BY 1),
    binned AS (
      SELECT feature, ref, least(greatest(floor((x - lo) / ((hi - lo) / 10)), 0), 9) AS bin
      FROM long JOIN lim USING (feature) WHERE x IS NOT NULL),
    counts AS (SELECT feature, bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c
               FROM binned GROUP BY 1, 2),
    shares AS (
      SELECT feature, sum(r) OVER (PARTITION BY feature) AS nr, sum(c) OVER (PARTITION BY feature) AS nc,
             r / sum(r) OVER (PARTITION BY feature) + 1e-6 AS rs,
             c / sum(c) OVER (PARTITION BY feature) + 1e-6 AS cs FROM counts),
    score AS (SELECT feature, CAST(max(nr) AS BIGINT) AS n_reference, CAST(max(nc) AS BIGINT) AS n_current,
                     sum((cs - rs) * ln(cs / rs)) AS psi FROM shares GROUP BY 1)
    SELECT feature, n_reference, n_current, round(psi, 4) AS psi, psi > {threshold} AS drift_detected,
           CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.3 THEN 'warn' ELSE 'critical' END AS severity
    FROM score
    """


@query("drift_psi", _psi_sql("orders", ["o_totalprice"], "o_orderkey", 0.15))
def drift_psi(spark, sf_dir):
    halves = drift.half_flag(table(spark, sf_dir, "orders"), "o_orderkey")
    return drift.psi(halves, ["o_totalprice"])


DRIFT_SQL = _psi_sql("lineitem", DRIFT_FEATURES, "l_extendedprice", 0.15)


@query("drift_dataset", DRIFT_SQL)
def drift_dataset(spark, sf_dir):
    """Halves by price, so the price itself drifts and the other columns hardly do."""
    halves = drift.half_flag(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return drift.psi(halves, DRIFT_FEATURES)


@query(
    "anomaly_zscore",
    """
    WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
    SELECT event_id, value, round((value - m) / sd, 2) AS z_score FROM events, s
    WHERE sd > 0 AND abs((value - m) / sd) > 3.0
    ORDER BY abs((value - m) / sd) DESC, event_id LIMIT 50
    """,
)
def anomaly_zscore(spark, sf_dir):
    return drift.zscore_anomalies(table(spark, sf_dir, "events"), "value", ["event_id"])


# --- features -------------------------------------------------------------------


@query(
    "feature_missing",
    """
    WITH required AS (
      SELECT DISTINCT p_brand AS model, unnest(string_split(p_name, ' ')) AS feature FROM part),
    available AS (
      SELECT DISTINCT unnest(string_split(p_name, ' ')) AS feature FROM part WHERE p_size = 1
      AND p_type = 'PROMO')
    SELECT model, count(*) AS required,
           count(*) FILTER (feature NOT IN (SELECT feature FROM available)) AS missing,
           CASE WHEN count(*) FILTER (feature NOT IN (SELECT feature FROM available)) = 0
                THEN 'ok' ELSE 'warn' END AS status
    FROM required GROUP BY model
    """,
)
def feature_missing(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    word = F.explode(F.split("p_name", " ")).alias("feature")
    required = part.select(F.col("p_brand").alias("model"), word)
    available = part.filter("p_size = 1 AND p_type = 'PROMO'").select(word)
    return features.missing_features(required, available)


@query(
    "feature_inventory",
    """
    SELECT 'parts' AS group_name, 6 AS columns, count(*) AS row_count FROM part
    UNION ALL SELECT 'suppliers', 4, count(*) FROM supplier
    """,
)
def feature_inventory(spark, sf_dir):
    return features.feature_inventory(
        {"parts": table(spark, sf_dir, "part"), "suppliers": table(spark, sf_dir, "supplier")}
    )


@query(
    "feature_prep",
    """
    SELECT p_partkey, CAST(coalesce(nullif(p_size, 7), 0) AS DOUBLE) AS p_size, p_retailprice,
           0.0 AS absent FROM part
    """,
)
def feature_prep(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("p_size", F.nullif("p_size", F.lit(7)))
    return features.prepare_features(part, ["p_size", "p_retailprice", "absent"], ["p_partkey"])


@query("sample_n")
def sample_n(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return features.sample_rows(orders, ["o_orderkey"], 1000).select("o_orderkey", "o_custkey")


# --- models ---------------------------------------------------------------------

NUMBERS = ["price_norm", "size_norm", "log_votes_norm", "supplier_avg_rating", "supplier_parts"]
FLAGS = [f"t_{t.lower()}" for t in TYPES] + [f"b_{b[6:]}" for b in BRANDS]
MODEL_FEATURES = NUMBERS + FLAGS


@functools.lru_cache(maxsize=8)
def _feature_table(spark, sf_dir) -> str:
    lake = Lakehouse(spark, scratch_path(spark, "lake"))
    return lake.write(part_features(spark, sf_dir), "gold_part_features")


def model_rows(spark, sf_dir):
    """The feature table, built once: training and scoring read it many times."""
    return spark.read.parquet(_feature_table(spark, sf_dir))


@functools.lru_cache(maxsize=8)
def _rating_model(spark, sf_dir, kind: str):
    estimator = (
        ml.random_forest_regressor("target_rating", trees=150, depth=8, min_leaf=20)
        if kind == "forest"
        else ml.gbt_regressor("target_rating", rounds=100, depth=4, rate=0.1)
    )
    train, test = ml.split_rows(model_rows(spark, sf_dir), ["p_partkey"])
    return ml.fit_regression(ml.spread(train, ml.TRAIN_ROWS), MODEL_FEATURES, estimator), ml.spread(test, ml.EXPLAIN_ROWS)


def _metric_rows(spark, metrics: dict[str, float]):
    rows = [(k, float(v)) for k, v in metrics.items()]
    return spark.createDataFrame(rows, "metric string, value double")


@query("ml_train_metrics")
def ml_train_metrics(spark, sf_dir):
    """All three algorithms of the train-a-table tool on the order amounts."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.year("o_orderdate").alias("year"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.month("o_orderdate").alias("month"),
    )
    rows = []
    for algorithm, target in (
        ("random_forest", "priority"),
        ("linear", "o_totalprice"),
        ("gradient_boosting", "o_totalprice"),
    ):
        done = ml.train_table(orders, target, ["o_orderkey"], algorithm)
        rows.append((algorithm, target, done.metric_name, done.metric, done.rows_trained))
    return spark.createDataFrame(
        rows, "algorithm string, target string, metric string, value double, rows_trained bigint"
    )


@query("ml_rf_regression")
def ml_rf_regression(spark, sf_dir):
    model, test = _rating_model(spark, sf_dir, "forest")
    return _metric_rows(spark, ml.regression_metrics(model, test, "target_rating"))


@query("ml_gbt_regression")
def ml_gbt_regression(spark, sf_dir):
    model, test = _rating_model(spark, sf_dir, "boosted")
    return _metric_rows(spark, ml.regression_metrics(model, test, "target_rating"))


@query("ml_rf_classifier")
def ml_rf_classifier(spark, sf_dir):
    """Part type from the other features, as the decade is predicted in the example."""
    rows = model_rows(spark, sf_dir).join(
        table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey"
    )
    train, test = ml.split_rows(rows, ["p_partkey"])
    model = ml.fit_classification(
        train, NUMBERS + FLAGS[len(TYPES):], "p_type", ml.random_forest_classifier(100, 8)
    )
    return _metric_rows(spark, ml.classification_metrics(model, test))


@query("ml_churn_gate")
def ml_churn_gate(spark, sf_dir):
    """Customers without an order in the last year, or any; promoted at 0.70 accuracy."""
    customer = table(spark, sf_dir, "customer")
    spend = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count("*").alias("orders"),
            F.sum("o_totalprice").alias("spent"),
            F.max("o_orderdate").alias("last_order"),
        )
    )
    late = F.col("last_order") < F.lit("2000-08-01").cast("timestamp_ntz")
    rows = customer.join(spend, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_acctbal", "c_nationkey",
        F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0)).alias("spent"),
        F.when(F.col("o_custkey").isNull(), 1).otherwise(late.cast("int")).alias("churned"),
    )
    train, test = ml.split_rows(rows, ["c_custkey"])
    model = ml.fit_classification(
        train, ["c_acctbal", "c_nationkey", "orders", "spent"], "churned",
        ml.random_forest_classifier(50, 6),
    )
    metrics = ml.classification_metrics(model, test)
    metrics["promoted"] = float(metrics["accuracy"] >= 0.70)
    return _metric_rows(spark, metrics)


@query("ml_predict")
def ml_predict(spark, sf_dir):
    """Save, register, promote, load the latest production model and score every part."""
    rows = model_rows(spark, sf_dir).select("p_partkey", "target_rating", *MODEL_FEATURES)
    done = ml.train_table(rows, "target_rating", ["p_partkey"], "linear")
    path = ml.save_model(done, scratch_path(spark, "models"), "rating")
    empty = spark.createDataFrame([], ml.REGISTRY_SCHEMA)
    registry = ml.register(empty, spark, "rating", path, done, version=1)
    registry = ml.promote(registry, "rating", 1, "production")
    entry = ml.latest_models(registry, "production").first()
    model = PipelineModel.load(entry["artifact_path"])
    return model.transform(rows).select("p_partkey", "target_rating", "prediction")


@query(
    "registry_latest",
    """
    WITH r AS (SELECT event_type AS model_name, event_id AS version,
               CASE user_id % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' ELSE 'development' END AS stage,
               ts AS created_at FROM events),
    newest AS (SELECT * FROM r QUALIFY row_number() OVER (
                 PARTITION BY model_name ORDER BY created_at DESC, version DESC) = 1),
    live AS (SELECT * FROM r WHERE stage = 'production' QUALIFY row_number() OVER (
                 PARTITION BY model_name ORDER BY created_at DESC, version DESC) = 1)
    SELECT n.model_name, n.version, n.stage, l.version AS production_version
    FROM newest n JOIN live l USING (model_name)
    """,
)
def registry_latest(spark, sf_dir):
    stage = F.col("user_id") % 3
    registry = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model_name"),
        F.col("event_id").alias("version"),
        F.when(stage == 0, "production").when(stage == 1, "staging").otherwise("development").alias(
            "stage"
        ),
        F.col("ts").alias("created_at"),
    )
    live = ml.latest_models(registry, "production").select(
        "model_name", F.col("version").alias("production_version")
    )
    return (
        ml.latest_models(registry)
        .join(live, "model_name")
        .select("model_name", "version", "stage", "production_version")
    )


@query(
    "experiment_leaderboard",
    """
    WITH last AS (
      SELECT event_type AS metric, user_id AS run_id, value AS last_value FROM events
      QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT metric, run_id, last_value,
           row_number() OVER (PARTITION BY metric ORDER BY
             CASE WHEN metric = 'error' THEN -last_value ELSE last_value END DESC, run_id) AS rank
    FROM last QUALIFY rank <= 3
    """,
)
def experiment_leaderboard(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("metric"),
        "value",
        F.col("ts").alias("logged_at"),
        F.col("event_id").alias("step"),
    )
    return ml.leaderboard(runs, lower_is_better=["error"], top=3)


def _formula_scores(spark, sf_dir):
    """A fixed formula in the place of a model, so that SQL can follow it."""
    predicted = 2.5 + (F.col("p_size") - 25) / 100.0
    return model_rows(spark, sf_dir).withColumn("predicted", predicted)


_FORMULA_SQL = """
    r AS (SELECT l_partkey, avg(l_extendedprice) / 10000 AS rating FROM lineitem
          GROUP BY 1 HAVING count(*) >= 5),
    p AS (SELECT p_partkey, p_brand, round(rating, 4) AS actual, 2.5 + (p_size - 25) / 100.0 AS predicted
          FROM part JOIN r ON p_partkey = l_partkey)
"""


@query(
    "eval_regression",
    f"""
    WITH {_FORMULA_SQL}, e AS (SELECT p_partkey, abs(predicted - actual) AS a FROM p)
    SELECT count(*) AS n, round(avg(a), 6) AS mae, round(sqrt(avg(a * a)), 6) AS rmse,
           (SELECT p_partkey FROM e ORDER BY a DESC, p_partkey LIMIT 1) AS worst,
           round(max(a), 6) AS worst_error,
           (SELECT p_partkey FROM e ORDER BY a, p_partkey LIMIT 1) AS best,
           round(min(a), 6) AS best_error
    FROM e
    """,
)
def eval_regression(spark, sf_dir):
    return ml.error_report(
        _formula_scores(spark, sf_dir), "target_rating", "predicted", "p_partkey"
    )


@query(
    "eval_group_consistency",
    f"""
    WITH {_FORMULA_SQL}
    SELECT p_brand, count(*) AS n, round(max(predicted) - min(predicted), 6) AS spread,
           round(stddev_pop(predicted), 6) AS std,
           CASE WHEN max(predicted) - min(predicted) < 0.3 THEN 'YES'
                WHEN max(predicted) - min(predicted) < 0.6 THEN 'PARTIAL' ELSE 'NO' END AS verdict
    FROM p GROUP BY 1 HAVING count(*) >= 2
    """,
)
def eval_group_consistency(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    scored = _formula_scores(spark, sf_dir).join(brands, "p_partkey")
    return ml.group_consistency(scored, "p_brand", "predicted")


@query("ml_importance")
def ml_importance(spark, sf_dir):
    model, _ = _rating_model(spark, sf_dir, "forest")
    return ml.feature_importance(model, MODEL_FEATURES, spark)


@query("ml_ablation")
def ml_ablation(spark, sf_dir):
    """Mean effect of zeroing each feature over the test parts."""
    model, test = _rating_model(spark, sf_dir, "forest")
    zeros = dict.fromkeys(MODEL_FEATURES, 0.0)
    effects = ml.replacement_effects(model, test, "p_partkey", MODEL_FEATURES, zeros)
    return effects.groupBy("feature").agg(F.avg("effect").alias("mean_effect"))


@query("ml_contribution")
def ml_contribution(spark, sf_dir):
    """Effect of putting each number at its median, for every test part."""
    model, test = _rating_model(spark, sf_dir, "forest")
    middles = test.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in MODEL_FEATURES]).first()
    return ml.replacement_effects(model, test, "p_partkey", MODEL_FEATURES, middles.asDict())


@query("ml_sensitivity")
def ml_sensitivity(spark, sf_dir):
    model, test = _rating_model(spark, sf_dir, "forest")
    grid = [i / 10 for i in range(11)]
    scan = ml.sensitivity(model, test, "p_partkey", "price_norm", grid)
    return scan.groupBy("value").agg(
        F.avg("prediction").alias("mean_prediction"), F.stddev_pop("prediction").alias("std")
    )


@query("ml_category_effect")
def ml_category_effect(spark, sf_dir):
    model, test = _rating_model(spark, sf_dir, "forest")
    return ml.category_effects(model, test, FLAGS[: len(TYPES)])
