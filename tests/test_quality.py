import pytest
from pyspark.sql import functions as F

from tarnlake.config import Quality
from tarnlake.operators import profile, schema
from tarnlake.operators.quality import (
    QualityFailure,
    Rule,
    TableTest,
    check_pipeline,
    custom_check,
    enforce,
    evaluate_rules,
    foreign_key_rule,
    gate,
    measure,
    run_table_tests,
    split_rows,
    uniqueness,
)

from .conftest import rows

PEOPLE = "id int, name string, age int"


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a", 5), (2, None, 200), (2, "c", None)], PEOPLE)


@pytest.fixture
def nobody(spark):
    return spark.createDataFrame([], PEOPLE)


def by_rule(df):
    return {r["rule"]: (r["checked"], r["failed"], r["passed"]) for r in df.collect()}


RULES = [
    Rule("NULL", "name"),
    Rule("TYPE", "name", {"type": "int"}),
    Rule("UNIQUE", "id"),
    Rule("RANGE", "age", {"min": 0, "max": 120}),
    Rule("ENUM", "name", {"allowed": ["a", "b"]}),
    Rule("PATTERN", "name", {"pattern": "^[a-z]$"}),
    Rule("EXPR", None, {"expr": "age > 1"}),
    Rule("NULL", "id", enabled=False),
]


def test_rules(people):
    assert by_rule(evaluate_rules(people, RULES)) == {
        "NULL:name": (3, 1, False),
        "TYPE:name": (2, 2, False),
        "UNIQUE:id": (3, 2, False),
        "RANGE:age": (2, 1, False),
        "ENUM:name": (2, 1, False),
        "PATTERN:name": (2, 0, True),
        "EXPR:row": (3, 0, True),
    }


def test_rules_on_no_rows(nobody):
    got = by_rule(evaluate_rules(nobody, RULES))
    assert len(got) == 7 and all(v == (0, 0, True) for v in got.values())


def test_row_rules_share_one_scan(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = evaluate_rules(df, [r for r in RULES if r.kind != "UNIQUE"])
    assert plan._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


def test_unknown_rule(people):
    with pytest.raises(ValueError):
        evaluate_rules(people, [Rule("SOUND", "name")])


def test_foreign_key_ignores_nulls_and_null_references(spark, people):
    ref = spark.createDataFrame([(5,), (None,)], "k int")
    assert by_rule(foreign_key_rule(people, "age", ref, "k")) == {"FK:age": (2, 1, False)}


def test_quarantine_and_failure(people):
    skip = [Rule("RANGE", "age", {"max": 120}, on_failure="skip"), Rule("NULL", "name")]
    kept, held = split_rows(people, skip)
    assert (kept.count(), held.count()) == (2, 1)
    assert held.first()["broken"] == "RANGE:age"
    assert enforce(people, skip).count() == 2
    with pytest.raises(QualityFailure, match="UNIQUE:id"):
        enforce(people, [Rule("UNIQUE", "id", on_failure="fail")])


def test_measures(spark, people, nobody):
    m = measure(people, ["id", "name"], ["id"]).first()
    assert m["row_count"] == 3 and abs(m["completeness"] - 5 / 6) < 1e-12
    assert abs(m["uniqueness"] - 2 / 3) < 1e-12
    empty = measure(nobody, ["id"], ["id"]).first()
    assert empty["completeness"] is None and empty["score"] is None
    nulls = spark.createDataFrame([(None,), (None,)], "v int")
    assert rows(uniqueness(nulls, ["v"])) == [("v", 0, 0, 1.0, True)]


def test_gate_on_empty_table_does_not_pass(nobody):
    assert gate(nobody, ["id"], "id", None, "bronze").first()["passed"] is False


def test_table_tests(people):
    tests = [TableTest("not_null", "name"), TableTest("unique", "id"), TableTest("range", "age", "0,100"),
             TableTest("row_count", None, "3")]
    now = F.lit("2024-01-01").cast("timestamp")
    got = {r["test"]: r["passed"] for r in run_table_tests(people, tests, now).collect()}
    assert got == {"not_null:name": False, "unique:id": False, "range:age": False, "row_count:table": True}


def test_pipeline_checks(people):
    gate_ = Quality(completeness=0.5, uniqueness=["id"], row_count_min=3, custom_sql="SELECT COUNT(*) = 3 AS x FROM _data")
    got = {c: ok for c, _, ok in check_pipeline(people, gate_)}
    assert got == {"completeness": True, "row_count": True, "uniqueness:id": False, "custom_sql": True}


def test_null_custom_check_fails(nobody):
    assert custom_check(nobody, "SELECT max(age) > 1 FROM _data").first()["passed"] is False


# --- contracts, profile, console ---------------------------------------------------


def test_schema_diff_and_accept(spark):
    old = schema.snapshot(spark.createDataFrame([], "a int, b string"), "t")
    new = schema.snapshot(spark.createDataFrame([], "a bigint, c string"), "t")
    events = schema.diff(old, new)
    assert {(r["kind"], r["column_name"]) for r in events.collect()} == {
        ("type_changed", "a"), ("removed", "b"), ("added", "c"),
    }
    assert schema.diff(old, old).count() == 0
    other = schema.snapshot(spark.range(1), "unknown")
    assert schema.diff(old, old.unionByName(other)).count() == 0
    marked, contract = schema.accept(
        events.withColumn("accepted", F.lit(False)), old, new, F.col("table_name") == "t"
    )
    assert marked.filter("accepted").count() == 3
    assert schema.diff(contract, new).count() == 0


def test_enforced_contract(spark):
    df = spark.createDataFrame([(1, "x", 2)], "a int, b string, extra int")
    assert schema.enforce(df, {"b": "string", "a": "bigint"}).dtypes == [("b", "string"), ("a", "bigint")]
    with pytest.raises(schema.SchemaViolation, match="removed"):
        schema.enforce(df, {"z": "int"})
    with pytest.raises(schema.SchemaViolation, match="type changed"):
        schema.enforce(df, {"b": "int"})


def test_profile(spark, people):
    got = {r["column_name"]: (r["nulls"], r["min"], r["mean"]) for r in profile.null_profile(people).collect()}
    assert got == {"id": (0, "1", 5 / 3), "name": (1, "a", None), "age": (1, "5", 102.5)}
    top = profile.top_values(people, ["id", "name"], 1)
    assert rows(top.select("column_name", "value", "n")) == [("id", "2", 2), ("name", "a", 1)]


def test_only_reading_is_allowed(spark):
    for text in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "", "CREATE VIEW v AS SELECT 1"):
        with pytest.raises(PermissionError):
            profile.read_only_sql(spark, text)
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        profile.read_only_sql(spark, "SELECT 1; DROP TABLE x")


def test_template_values_are_never_text(spark):
    template = profile.SqlTemplate(
        "SELECT :word AS w, :n + 1 AS n", [profile.Param("word", required=True), profile.Param("n", "int", default=4)]
    )
    assert rows(template.call(spark, {"word": "x'; DROP TABLE t; --"})) == [("x'; DROP TABLE t; --", 5)]
    with pytest.raises(TypeError, match="missing"):
        template.call(spark)
    with pytest.raises(TypeError, match="unknown"):
        template.call(spark, {"word": "a", "x": 1})
