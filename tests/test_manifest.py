"""Batches that become visible in one step, buckets that stay as they are, and runs that die halfway."""

import datetime as dt
import itertools
import os

import pytest
from pyspark.sql import functions as F

from tarnlake.config import project_from_dict
from tarnlake.operators.graph import ancestor_chain
from tarnlake.operators.quality import QualityFailure
from tarnlake.operators.runs import Runner
from tarnlake.operators.upserts import CLOSED, merge_scd1, merge_scd2, put_keyed
from tarnlake.session import scratch_path
from tarnlake.sources import tables
from tarnlake.sources.manifest import ManifestFolder
from tarnlake.sources.tables import Batch, Lakehouse

from .conftest import rows


@pytest.fixture
def lake(spark):
    return Lakehouse(spark, scratch_path(spark, "lake"))


def files(lake, name):
    return {f"{part}/{f}" for part in lake.parts(name) for f in os.listdir(part.removeprefix("file:")) if f.startswith("part-")}


def test_all_or_nothing(spark, lake):
    lake.write(spark.range(3), "bronze_a")
    with pytest.raises(ZeroDivisionError), lake.batch() as batch:
        batch.put("bronze/bronze_a", [batch.stage(spark.range(9), "bronze/bronze_a")])
        batch.put("silver/b", [batch.stage(spark.range(1), "silver/b")])
        batch.marks["x"] = "1"
        1 / 0
    assert lake.tables() == [("bronze", "bronze_a")] and lake.read("bronze_a").count() == 3
    assert lake.manifest().marks == {}
    assert lake.vacuum() == 2  # what the failed batch left
    assert lake.read("bronze_a").count() == 3


def test_second_writer_is_refused(spark, lake):
    first, second = lake.batch(), lake.batch()
    first.put("silver/t", [first.stage(spark.range(1), "silver/t")])
    second.put("silver/t", [second.stage(spark.range(2), "silver/t")])
    first.commit()
    with pytest.raises(RuntimeError, match="another batch"):
        second.commit()
    assert lake.read("t").count() == 1


def test_versions_compaction_and_vacuum(spark, lake):
    lake.write(spark.range(2), "t")
    lake.append(spark.range(2, 5), "t")
    lake.append(spark.range(0), "t")  # an empty part is not listed
    assert [lake.read("t", version=v).count() for v in (1, 2)] == [2, 5]
    assert lake.entry("t").rows == 5 and len(lake.parts("t")) == 2
    lake.write(lake.read("t").where("id > 0"), "t")  # reads what it replaces
    assert lake.read("t").count() == 4
    lake.append(spark.range(1), "t")
    assert lake.compact("t") == 2 and len(lake.parts("t")) == 1
    assert rows(lake.read("t")) == [(0,), (1,), (2,), (3,), (4,)]
    assert lake.vacuum() >= 4 and lake.read("t").count() == 5
    with pytest.raises(Exception, match="does not exist|File"):
        lake.read("t", version=1).count()
    with pytest.raises(LookupError):
        lake.read("nowhere")


def keyed(spark, lake, n=1000):
    df = spark.range(n).selectExpr("id AS k", "id * 2 AS v", "CAST('2024-01-01' AS timestamp) AS ts")
    with lake.batch() as batch:
        put_keyed(batch, "silver/dim", df, ["k"], bucket_rows=100)


def test_scd1_rewrites_touched_buckets_only(spark, lake):
    keyed(spark, lake)
    assert lake.entry("dim").buckets == 10
    before = files(lake, "dim")
    changes = spark.sql("SELECT 7 AS k, -1L AS v, TIMESTAMP'2024-02-01' AS ts UNION ALL SELECT 7, -2, TIMESTAMP'2023-01-01'")
    with lake.batch() as batch:
        rewritten = merge_scd1(batch, "silver/dim", changes, ["k"], "ts")
    assert rewritten < 200
    assert len(before & files(lake, "dim")) == len(before) - 1
    assert lake.read("dim").where("k = 7").first()["v"] == -1
    assert lake.read("dim").count() == 1000 == lake.entry("dim").rows
    late = spark.sql("SELECT 7 AS k, -3L AS v, TIMESTAMP'2024-01-15' AS ts UNION ALL SELECT 5000, 1, TIMESTAMP'2024-01-15'")
    with lake.batch() as batch:
        merge_scd1(batch, "silver/dim", late, ["k"], "ts")
    assert rows(lake.read("dim").where("k in (7, 5000)").select("k", "v")) == [(5000, 1), (7, -1)]
    with lake.batch() as batch:  # nothing to do
        assert merge_scd1(batch, "silver/dim", late.limit(0), ["k"], "ts") == 0
    with pytest.raises(ValueError), lake.batch() as batch:
        merge_scd1(batch, "silver/dim", late, ["v"], "ts")


def test_scd2_leaves_closed_and_untouched_versions(spark, lake):
    def apply(sql):
        with lake.batch() as batch:
            return rows(merge_scd2(batch, "silver/hist", spark.sql(sql), ["k"], "ts", ["v"], bucket_rows=20).select("k", "v"))

    apply("SELECT id AS k, 'a' AS v, TIMESTAMP'2024-01-01' AS ts FROM range(200) UNION ALL SELECT id, 'b', TIMESTAMP'2024-01-02' FROM range(100)")
    first = files(lake, "hist")
    assert lake.read("hist").count() == 300 and lake.entry("hist").buckets == 15
    rejected = apply(
        "SELECT 3 AS k, 'c' AS v, TIMESTAMP'2024-01-05' AS ts UNION ALL SELECT 3, 'x', TIMESTAMP'2023-01-01'"
        " UNION ALL SELECT 4, 'y', NULL UNION ALL SELECT 900, 'n', TIMESTAMP'2024-01-05'"
    )
    assert rejected == [(3, "x"), (4, "y")]
    again = files(lake, "hist")
    assert len(first - again) <= 2 and len([p for p in lake.entry("hist").parts if p.kind == CLOSED]) == 2
    got = rows(lake.read("hist").where("k in (3, 900)").selectExpr("k", "v", "effective_to IS NULL", "is_current"))
    assert got == [(3, "a", False, False), (3, "b", False, False), (3, "c", True, True), (900, "n", True, True)]


def project(path):
    return project_from_dict({
        "sources": {"feed": {"type": "parquet", "path": f"{path}/feed"}, "people": {"type": "parquet", "path": f"{path}/people"}},
        "pipelines": {
            "people": {"source": "people", "destination": "silver_people"},
            "load": {
                "source": "feed", "destination": "silver_sales", "fetch_mode": "incremental", "watermark_col": "ts", "depends_on": ["people"],
                "contract": {"id": "bigint", "person": "bigint", "amount": "double", "ts": "timestamp"},
                "rules": [
                    {"type": "FK", "column": "person", "ref_table": "silver_people", "ref_col": "id", "on_failure": "skip"},
                    {"type": "RANGE", "column": "amount", "min": 0, "on_failure": "skip"}, {"type": "NULL", "column": "id", "on_failure": "fail"},
                    {"type": "UNIQUE", "column": "id"},
                ],
            },
            "latest": {"source": "silver_sales", "destination": "gold_latest", "depends_on": ["load"], "scd": {"type": 1, "key": "person", "ts": "ts"}},
            "history": {
                "source": "silver_sales", "destination": "gold_history", "depends_on": ["load"],
                "scd": {"type": 2, "key": "person", "ts": "ts", "tracked": "amount"},
            },
        },
    })


def land(spark, path, sales):
    data = [(i, p, float(a), dt.datetime(2024, 1, d)) for i, p, a, d in sales]
    spark.createDataFrame(data, "id int, person int, amount double, ts timestamp").write.mode("append").parquet(f"{path}/feed")


@pytest.fixture
def feed(spark, tmp_path):
    spark.range(1, 4).write.parquet(f"{tmp_path}/people")
    land(spark, tmp_path, [(1, 1, 5, 1), (2, 2, 6, 1), (3, 9, 7, 2), (4, 3, -1, 2), (5, 1, 8, 3)])
    return str(tmp_path)


def state(runner):
    return (
        rows(runner.lake.read("silver_sales").select("id", "amount")), rows(runner.lake.read("gold_latest").select("person", "id")),
        rows(runner.lake.read("gold_history").select("person", "amount", "is_current")), rows(runner.quarantine("load").select("id", "broken")),
        rows(runner.watermarks()), runner.hashes().count(),
    )


WANTED = (
    [(1, 5.0), (2, 6.0), (5, 8.0), (6, 9.0)], [(1, 5), (2, 6)], [(1, 5.0, False), (1, 8.0, True), (2, 6.0, False), (2, 9.0, True)],
    [(3, "FK:person"), (4, "RANGE:amount")], [("load", dt.datetime(2024, 1, 4))], 6,
)


def test_whole_project_twice(spark, lake, feed):
    runner = Runner(spark, project(feed), lake)
    assert {r["status"] for r in runner.run_all().collect()} == {"success"}
    land(spark, feed, [(6, 2, 9, 4)])
    for _ in range(2):  # the second time nothing is new
        assert {r["status"] for r in runner.run_all().collect()} == {"success"}
        assert state(runner) == WANTED
    told = runner.rule_results().where("rule = 'FK:person' AND NOT passed").first()
    assert (told["checked"], told["failed"]) == (5, 1)
    events = runner.lineage()
    assert {r[0] for r in events.select("operation").distinct().collect()} == {"ingest", "transform", "enrich"}
    assert events.where("operation <> 'ingest' AND parent_id IS NULL").count() == 0
    start = events.where("destination = 'gold_latest'").agg(F.max("event_id").alias("node"))
    chain = ancestor_chain(events, "event_id", "parent_id", start).join(events, F.col("node") == F.col("event_id"))
    assert rows(chain.select("distance", "operation", "destination")) == [(0, "enrich", "gold_latest"), (1, "transform", "silver_sales"), (2, "ingest", "feed")]


def test_a_crash_anywhere_loses_and_doubles_nothing(spark, lake, feed, monkeypatch):
    """The driver dies after every write of a run, before its commit and right after it; the run is then repeated."""
    runner = Runner(spark, project(feed), lake)
    runner.run_all()
    land(spark, feed, [(6, 2, 9, 4)])

    def dying(real, at, before):
        calls = itertools.count()

        def step(*args, **more):
            here = next(calls) == at
            if here and before:
                raise OSError("the driver died")
            out = real(*args, **more)
            if here:
                raise OSError("the driver died")
            return out

        return step

    for pipeline in ("load", "latest", "history"):
        held, reached = lake.manifest(), []
        real = tables.write_table
        for at in itertools.count():
            with monkeypatch.context() as patched:
                patched.setattr(tables, "write_table", dying(real, at, False))
                patched.setattr(ManifestFolder, "switch", dying(lambda *_: reached.append(at), 0, False))
                with pytest.raises(OSError):
                    runner.run(pipeline)
            assert lake.manifest() == held
            if reached:  # no write was left to die at
                break
        with monkeypatch.context() as patched:
            patched.setattr(ManifestFolder, "switch", dying(ManifestFolder.switch, 0, False))
            with pytest.raises(OSError):
                runner.run(pipeline)
        assert lake.manifest().version == held.version + 1
        runner.run(pipeline)
    assert state(runner) == WANTED


def test_failing_rule_blocks_the_write(spark, lake, feed):
    raw = project(feed)
    pipelines = dict(raw.pipelines)
    pipelines["load"] = type(pipelines["load"])(**{**vars(pipelines["load"]), "rules": ({"type": "FK", "column": "person", "ref_table": "silver_people", "ref_col": "id", "on_failure": "fail"},), "attempts": 3})
    runner = Runner(spark, type(raw)(raw.sources, pipelines), lake)
    log = {r["pipeline"]: r for r in runner.run_all().collect()}
    assert log["load"]["status"] == "failed" and "FK:person" in log["load"]["error"]
    assert not lake.exists("silver_sales") and runner.hashes().count() == 0
    dead = {r["pipeline"]: r["attempts"] for r in runner.dead_letters().collect()}
    assert dead["load"] == 3 and dead["latest"] == 1
    with pytest.raises(QualityFailure):
        runner.run("load")


def test_retry_succeeds(spark, lake, feed, monkeypatch):
    raw = project(feed)
    people = type(raw.pipelines["people"])(**{**vars(raw.pipelines["people"]), "attempts": 2})
    runner = Runner(spark, type(raw)(raw.sources, {"people": people}), lake)
    real, calls = Batch.stage, itertools.count()

    def once(self, *args, **more):
        if not next(calls):
            raise OSError("the store is away")
        return real(self, *args, **more)

    monkeypatch.setattr(Batch, "stage", once)
    assert runner.run_all().first()["status"] == "success"
    assert runner.dead_letters().count() == 0
