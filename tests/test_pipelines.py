import datetime as dt
import json

import pytest

from tarnlake.config import layer_of, load_project, project_from_dict
from tarnlake.operators.runs import Runner, dependents, roots, run_order
from tarnlake.operators.transforms import (
    apply_steps,
    deduplicate,
    fill_null,
    moved_step,
    sql_step,
    stage_counts,
    with_step,
    without_step,
)
from tarnlake.session import scratch_path
from tarnlake.sources.tables import Lakehouse

from .conftest import rows


def test_order_chain_fanout_and_diamond():
    assert run_order({"c": ["b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    diamond = {"d": ["b", "c"], "b": ["a"], "c": ["a"], "a": []}
    order = run_order(diamond)
    assert order[0] == "a" and order[-1] == "d" and len(order) == 4
    assert roots(diamond) == ["a"]
    assert dependents(diamond, "a") == ["b", "c"]


def test_cycle_is_an_error():
    with pytest.raises(ValueError, match="cycle"):
        run_order({"a": ["b"], "b": ["a"]})


def test_unknown_dependency_is_an_outside_table():
    assert run_order({"a": ["elsewhere"]}) == ["a"]


def test_layers():
    assert [layer_of(n) for n in ("bronze_x", "gold_x", "silver_x", "x")] == [
        "bronze", "gold", "silver", "silver",
    ]
    assert layer_of("x", "gold") == "gold"
    with pytest.raises(ValueError):
        layer_of("x", "platinum")


def test_steps(spark):
    df = spark.createDataFrame([(1, -1, None), (2, 5, "x"), (2, 5, "y")], "id int, age int, name string")
    out = apply_steps(
        df,
        [
            {"type": "filter", "condition": "age > 0"},
            {"type": "derive", "name": "adult", "expression": "age >= 18"},
            {"type": "deduplicate", "key": "id"},
            {"type": "sql", "sql": "SELECT id, name, adult FROM _data ORDER BY id; "},
        ],
    )
    assert rows(out) == [(2, "x", False)]
    with pytest.raises(ValueError, match="unknown step"):
        apply_steps(df, [{"type": "pivot"}])


def test_dedup_does_not_depend_on_row_order(spark, partitions):
    df = spark.createDataFrame([(1, v) for v in "cab"], "k int, v string")
    for _ in partitions():
        for n in (1, 3):
            assert rows(deduplicate(df.repartition(n), ["k"])) == [(1, "a")]


def test_fill_null_casts_to_the_column(spark):
    df = spark.createDataFrame([(None, None)], "n int, s string")
    assert rows(fill_null(df, {"n": "7", "s": "x"})) == [(7, "x")]


def test_sql_step_with_own_cte_and_comment(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    out = sql_step(df, "-- twice\nWITH t AS (SELECT n * 2 AS n FROM _data) SELECT sum(n) AS s FROM t -- end")
    assert rows(out) == [(6,)]


def test_step_lists():
    assert with_step([1, 2], 3) == [1, 2, 3]
    assert with_step([1, 2], 3, 0) == [3, 1, 2]
    assert without_step([1, 2, 3], 1) == [1, 3]
    assert moved_step([1, 2, 3], 0, 2) == [2, 3, 1]


def test_stage_counts(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    steps = [{"type": "filter", "condition": "n >= 4"}, {"type": "filter", "condition": "n >= 8"}]
    assert [r["row_count"] for r in stage_counts(df, steps).orderBy("stage").collect()] == [10, 6, 2]


def users_csv(folder, body="id,name,age\n1,Ann,30\n2,Bob,-1\n3,Cem,40\n"):
    path = folder / "users.csv"
    path.write_text(body)
    return str(path)


def test_csv_pipeline_end_to_end(spark, tmp_path):
    project = project_from_dict(
        {
            "data": {
                "sources": {"users": {"type": "csv", "path": users_csv(tmp_path)}},
                "pipelines": {
                    "ingest": {
                        "source": "users",
                        "transforms": [{"type": "filter", "condition": "age > 0"}],
                        "quality": {"completeness": 0.9, "uniqueness": ["id"], "row_count_min": 1},
                        "destination": "bronze_users",
                    },
                    "strict": {
                        "source": "bronze_users",
                        "quality": {"row_count_min": 100},
                        "depends_on": ["ingest"],
                    },
                    "lost": {"source": "nowhere"},
                },
            }
        }
    )
    runner = Runner(spark, project, Lakehouse(spark, scratch_path(spark, "lake")))
    log = {r["pipeline"]: r for r in runner.run_all().collect()}
    assert log["ingest"]["status"] == "success"
    assert (log["ingest"]["rows_in"], log["ingest"]["rows_out"]) == (3, 2)
    assert log["strict"]["status"] == "failed" and "row_count" in log["strict"]["error"]
    assert log["lost"]["status"] == "failed"
    assert rows(runner.lake.read("bronze_users").select("name")) == [("Ann",), ("Cem",)]
    assert ("silver", "strict") not in runner.lake.tables()
    assert runner.run_log().count() == 3
    ingest, transform = runner.lineage().orderBy("operation").collect()
    assert (ingest["operation"], transform["operation"]) == ("ingest", "transform")
    assert transform["parent_id"] == ingest["event_id"] and ingest["parent_id"] is None


def incremental_runner(spark, path):
    project = project_from_dict(
        {
            "sources": {"feed": {"type": "parquet", "path": path}},
            "pipelines": {
                "load": {
                    "source": "feed",
                    "destination": "bronze_feed",
                    "fetch_mode": "incremental",
                    "watermark_col": "ts",
                }
            },
        }
    )
    return Runner(spark, project, Lakehouse(spark, scratch_path(spark, "lake")))


def feed(spark, path, days):
    data = [(d, dt.datetime(2024, 1, d)) for d in days]
    spark.createDataFrame(data, "n int, ts timestamp").write.mode("append").parquet(path)


def test_incremental_load_twice_and_backfill(spark, tmp_path):
    path = str(tmp_path / "feed")
    feed(spark, path, [1, 2])
    runner = incremental_runner(spark, path)
    assert runner.run("load") == {"rows_in": 2, "rows_out": 2}
    assert runner.run("load") == {"rows_in": 0, "rows_out": 0}
    feed(spark, path, [2, 3])
    assert runner.run("load")["rows_out"] == 1
    assert rows(runner.lake.read("bronze_feed").select("n")) == [(1,), (2,), (3,)]
    assert rows(runner.watermarks()) == [("load", dt.datetime(2024, 1, 3))]
    # A late row lies behind the watermark: a backfill that keeps the hashes takes it in.
    feed(spark, path, [1])
    spark.createDataFrame([(9, dt.datetime(2024, 1, 1))], "n int, ts timestamp").write.mode(
        "append"
    ).parquet(path)
    assert runner.run("load")["rows_out"] == 0
    assert runner.backfill("load", clear_hashes=False)["rows_out"] == 1
    assert runner.backfill("load")["rows_out"] == 4
    assert rows(runner.lake.read("bronze_feed").select("n")) == [(1,), (2,), (3,), (9,)]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "string", "date"])
def test_incremental_load_of_other_time_types(spark, tmp_path, kind):
    path = str(tmp_path / "feed")
    runner = incremental_runner(spark, path)
    for n in (1, 2):
        spark.sql(f"SELECT {n} AS n, CAST(TIMESTAMP'2024-01-0{n}' AS {kind}) AS ts").write.mode(
            "append"
        ).parquet(path)
        assert runner.run("load")["rows_out"] == 1
    assert runner.watermarks().first()["watermark"] == dt.datetime(2024, 1, 2)


def test_project_files(tmp_path):
    raw = {"sources": {"a": {"type": "csv", "path": "x"}}, "pipelines": {"p": {"source": "a"}}}
    path = tmp_path / "project.json"
    path.write_text(json.dumps(raw))
    assert load_project(str(path)).pipelines["p"].target == "p"
    pytest.importorskip("yaml")
    path = tmp_path / "project.yaml"
    path.write_text("data:\n  sources:\n    a: {type: csv, path: x}\n  pipelines:\n    p: {source: a}\n")
    assert load_project(str(path)).sources["a"].type == "csv"
