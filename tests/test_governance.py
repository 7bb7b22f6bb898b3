import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnlake.functions.udfs import parameters, register_function, sql_type
from tarnlake.operators import calendars, graph, lineage, oplog, privacy

from .conftest import rows

TEXTS = {
    1: "ssn 123-45-6789 end",
    2: "born 1987-03-05.",
    3: "cards 1234 5678 9012 3456 1111-2222-3333-4444",
    4: "mail a.b@c.org or 10.0.0.1",
    5: "call +49 30 1234 567",
    6: "clean text",
    7: None,
    8: "6789-123-45-67891",
}


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id int, t string")


def test_scan(texts):
    got = {r["pii_type"]: r["row_count"] for r in privacy.scan(texts, ["t"]).collect()}
    assert got["ssn"] == 1 and got["date_of_birth"] == 1 and got["email"] == 1
    assert got["ip_address"] == 1 and got["credit_card"] == 1 and got["phone"] >= 1


def test_masking_reaches_neighbouring_matches(texts):
    strategies = dict.fromkeys(privacy.PATTERNS, "redact")
    got = {r["id"]: r["t"] for r in privacy.mask_text(texts, ["t"], strategies).collect()}
    assert got[1] == "ssn [ssn] end"
    assert got[2] == "born [date_of_birth]."
    assert got[3] == "cards [credit_card] [credit_card]"
    assert got[4] == "mail [email] or [ip_address]"
    assert got[6] == "clean text" and got[7] is None


def test_blocking(texts):
    passed, held = privacy.split_blocked(texts, "t", privacy.default_modes())
    assert {r["id"]: r["held_for"] for r in held.collect()} == {1: "ssn", 3: "credit_card"}
    assert passed.count() == 6


def test_field_strategies(spark):
    df = spark.createDataFrame([("x@y.org",), ("x@y.org",), (None,)], "m string")
    for strategy in ("mask", "redact", "hash", "pseudonymize"):
        got = [r[0] for r in privacy.protect_fields(df, {"m": strategy}, "s").collect()]
        assert got[0] == got[1] != "x@y.org" and got[2] is None
    a = privacy.protect_fields(df, {"m": "pseudonymize"}, "one").first()[0]
    assert a != privacy.protect_fields(df, {"m": "pseudonymize"}, "two").first()[0]
    with pytest.raises(ValueError):
        privacy.protect_fields(df, {"m": "shout"})


def test_modes():
    assert [privacy.mode_of(s) for s in ("Mask", "hash", "block", "allow")] == ["mask", "mask", "block", "allow"]
    with pytest.raises(ValueError):
        privacy.mode_of("unmasked")


def test_days_are_filled(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 5),), (dt.datetime(2023, 1, 1),)], "ts timestamp")
    assert rows(calendars.daily_counts(df, "ts", "2024-01-03", 3)) == [
        ("2024-01-01", 0), ("2024-01-02", 1), ("2024-01-03", 0),
    ]


# --- graphs ---------------------------------------------------------------------

EDGES = "parent string, child string"


def test_depth_of_a_diamond(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")], EDGES)
    assert rows(graph.longest_depth(edges)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_depth_refuses_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], EDGES)
    with pytest.raises(ValueError, match="cycle"):
        graph.longest_depth(edges)


def test_reachable_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], EDGES)
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.reachable(edges, start, "downstream")) == [("a", "b", 1), ("a", "c", 2)]
    assert rows(graph.reachable(edges, start, "upstream")) == [("a", "b", 1)]
    nowhere = spark.createDataFrame([("z",)], "node string")
    assert graph.reachable(edges, nowhere, "upstream").count() == 0


def test_long_chain_takes_few_rounds(spark):
    n = 1000
    events = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent")
    start = spark.createDataFrame([(n - 1,)], "node bigint")
    chain = graph.ancestor_chain(events, "id", "parent", start)
    assert rows(chain.select("distance", "node")) == [(d, n - 1 - d) for d in sorted(range(n), key=lambda d: repr((d, n - 1 - d)))]


def test_lineage_tables(spark):
    events = spark.createDataFrame(
        [("s", "a", "p"), ("s", "a", "p"), ("a", "b", "q"), (None, "b", "q")],
        "source string, destination string, pipeline_name string",
    )
    edges = lineage.distinct_edges(events)
    assert rows(edges) == [("a", "b", "q"), ("s", "a", "p")]
    assert rows(lineage.node_pipelines(edges)) == [("a", "p"), ("a", "q"), ("b", "q"), ("s", "p")]
    sources = spark.createDataFrame([("s",)], "name string")
    assert rows(lineage.config_edges(events, sources)) == [("a", "b"), ("s", "a")]


# --- logs -----------------------------------------------------------------------

RUNS = "run_id int, job string, started_at timestamp, finished_at timestamp, status string"


def runs(spark, *entries):
    data = []
    for i, (job, status) in enumerate(entries):
        start = dt.datetime(2024, 1, 1, 0, i)
        data.append((i, job, start, start + dt.timedelta(seconds=90), status))
    return spark.createDataFrame(data, RUNS)


def test_dead_letters(spark):
    log = runs(
        spark,
        ("never", "failed"), ("never", "failed"),
        ("healed", "failed"), ("healed", "failed"), ("healed", "success"), ("healed", "failed"),
        ("relapsed", "success"), ("relapsed", "failed"), ("relapsed", "running"), ("relapsed", "failed"),
    )
    assert rows(oplog.dead_letters(log).select("job", "attempts")) == [("never", 2), ("relapsed", 2)]


def test_bars_rates_and_durations(spark):
    log = runs(spark, *[("a", "success")] * 3, ("a", "failed"), ("b", "success"))
    assert rows(oplog.last_seven(log)) == [("a", "---ooox"), ("b", "------o")]
    assert rows(oplog.success_rates(log)) == [("a", 4, 0.75), ("b", 1, 1.0)]
    assert oplog.recent_runs(log, 1).first()["duration_s"] == 90.0
    assert oplog.recent_runs(log, 9, job="a").count() == 4


def test_slots(spark):
    few = runs(spark, ("a", "success"), ("a", "failed"), ("a", "running"))
    got = [r["status"] for r in oplog.day_slots(few, "2024-01-01").orderBy("slot").collect()]
    assert got == ["ok", "fail", "running", "empty", "empty", "empty", "empty"]
    many = runs(spark, *[("a", "success")] * 15)
    counts = [r["runs"] for r in oplog.day_slots(many, "2024-01-01").orderBy("slot").collect()]
    assert counts == [2, 2, 2, 2, 2, 2, 3]
    none = oplog.day_slots(many, "2020-01-01").collect()
    assert len(none) == 7 and all(r["status"] == "empty" for r in none)


def test_levels_compare_by_severity(spark):
    logs = spark.createDataFrame(
        [(1, "INFO", 1), (2, "warning", 2), (3, "CRITICAL", 3), (4, "odd", 4)], "log_id int, level string, logged_at int"
    )
    assert sorted(r["log_id"] for r in oplog.log_filter(logs, "warning").collect()) == [2, 3]


def test_costs_without_spend(spark):
    none = spark.createDataFrame([("p", 0.0)], "provider string, cost_usd double")
    assert oplog.cost_by_provider(none, 10).count() == 0
    some = spark.createDataFrame([("p", 30.0), ("q", 10.0), ("", 5.0)], none.schema)
    assert rows(oplog.cost_by_provider(some, 10)) == [("p", 30.0, 0.75, 100.0), ("q", 10.0, 0.25, 100.0)]


def test_user_functions(spark):
    def greet(name: str, times: int = 2) -> str:
        return name * times

    def parts(text: str) -> list[str]:
        return text.split("-")

    register_function(spark, greet)
    register_function(spark, parts)
    got = spark.sql("SELECT greet('ab') AS a, greet('x', 3) AS b, parts('p-q') AS c").first()
    assert (got["a"], got["b"], got["c"]) == ("abab", "xxx", ["p", "q"])
    assert [(p.name, p.type, p.required) for p in parameters(greet)] == [
        ("name", "string", True), ("times", "bigint", False),
    ]
    assert sql_type(float | None) == "double"
    with pytest.raises(TypeError):
        sql_type(object)


def test_rules_from_scores_and_runs(spark):
    from tarnlake.operators import oplog

    scores = spark.createDataFrame([("a", 0.5, True, "critical"), ("b", 0.01, False, "ok")], "feature string, psi double, drift_detected boolean, severity string")
    runs = spark.createDataFrame(
        [("1", "j", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), "success"), ("2", "j", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2), "failed")],
        "run_id string, job string, started_at timestamp, finished_at timestamp, status string",
    )
    got = {(r["rule"], r["subject"], r["severity"], r["state"]) for r in oplog.alert_rules(scores, runs).collect()}
    assert got == {("feature_drift", "a", "critical", "firing"), ("feature_drift", "b", "ok", "quiet"), ("job_broken", "j", "critical", "firing")}


@pytest.mark.parametrize("text", ["FROM src_t INSERT INTO dst_t SELECT *", "WITH a AS (SELECT 1 AS x) INSERT INTO dst_t SELECT * FROM a", "SELECT 1; DROP TABLE dst_t"])
def test_console_refuses_writes(spark, text):
    from pyspark.errors import ParseException

    from tarnlake.operators.profile import read_only_sql

    with pytest.raises((PermissionError, ParseException)):
        read_only_sql(spark, text)
    assert read_only_sql(spark, "WITH a AS (SELECT 'INSERT INTO' AS x) SELECT * FROM a").first()[0] == "INSERT INTO"


def test_keyed_tokens_in_text_and_back(spark):
    card, ssn, mail = "4111 1111 1111 1111", "123-45-6789", "a.b@x.org"
    texts = [
        (1, f"{ssn} {ssn},{ssn} to {mail}"), (2, f"card {card} 123-45-6789"), (3, None), (4, ""), (5, "nothing, [ssn:abc] here"),
        (6, mail), (7, f"born 1990-01-02, {mail};{mail}"), (8, f"host 10.0.0.1 10.0.0.2"),
    ]
    df = spark.createDataFrame(texts, "id int, t string")
    strategies = {"ssn": "pseudonymize", "email": "hash", "credit_card": "pseudonymize", "date_of_birth": "mask", "ip_address": "redact"}
    made = privacy.tokenize_text(df, "t", strategies, "k").cache()
    got = {r["id"]: r["t"] for r in made.collect()}
    assert got[3] is None and got[4] == "" and got[5] == texts[4][1]
    assert not any(v in t for t in got.values() if t for v in (card, ssn, mail, "1990-01-02", "10.0.0"))
    assert got[1].count("[ssn:") == 3 and len(set(got[1].split(" to ")[0].replace(",", " ").split())) == 1
    assert got[8] == "host [ip_address] [ip_address]" and "****" in got[7]
    table = privacy.token_table(made).cache()
    assert {(r["kind"], r["value"], r["n"]) for r in table.collect()} == {("ssn", ssn, 4), ("credit_card", card, 1), ("email", mail, 4)}
    back = {r["id"]: r["t"] for r in privacy.restore_text(made.drop("spans"), "id", "t", table).collect()}
    assert {k: back[k] for k in (1, 2, 3, 4, 5, 6)} == dict(texts[:6])
    assert back[7] == f"born ****, {mail};{mail}"
    other = privacy.tokenize_text(df, "t", strategies, "other").where("id = 6").first()["t"]
    assert other != got[6] and privacy.tokenize_text(df, "t", strategies, "k").where("id = 6").first()["t"] == got[6]


def test_only_rows_with_a_token_are_restored_by_a_join(spark):
    texts = [(1, "call +1 555-123-4567 or a@b.org"), (2, "nothing here"), (3, None), (4, "at 7 @ eight"), (5, "a@b.org")]
    df = spark.createDataFrame(texts, "id bigint, t string")
    made = privacy.tokenize_text(df, "t", dict.fromkeys(("phone", "email"), "pseudonymize"), "s")
    found = {r["id"]: len(r["spans"]) for r in made.collect()}
    assert found == {1: 2, 2: 0, 3: 0, 4: 0, 5: 1}
    back = privacy.restore_text(made.select("id", "t"), "id", "t", privacy.token_table(made))
    assert sorted((r["id"], r["t"]) for r in back.collect()) == texts
    assert "Union" in back._jdf.queryExecution().optimizedPlan().toString()
