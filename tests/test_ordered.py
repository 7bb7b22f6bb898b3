import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnlake.functions.ordered import (
    counts_before,
    exact_quantile,
    first_per_key,
    null_safe_join,
    rank_split,
    row_numbers,
    top_per_key,
)

from .conftest import rows


def make(spark, n=3000, seed=1):
    """A third of the rows in one key, and many ties."""
    pick = random.Random(seed)
    data = [
        (i, "hot" if pick.random() < 0.34 else f"k{pick.randrange(20)}", float(pick.randrange(50)))
        for i in range(n)
    ]
    return data, spark.createDataFrame(data, "id bigint, k string, v double")


def brute_rank(data, descending):
    out = {}
    for i, k, v in data:
        ahead = sum(1 for _, k2, v2 in data if k2 == k and (v2 > v if descending else v2 < v))
        out[i] = ahead + 1
    return out


def test_rank_split_matches_brute_force(spark, partitions):
    data, df = make(spark, 900)
    for descending in (True, False):
        want = brute_rank(data, descending)
        for _ in partitions():
            # 100 rows make a key hot, so both ways of ranking run side by side.
            got = rank_split(df.repartition(5), ["k"], "v", "r", descending, hot_rows=100)
            assert {r["id"]: r["r"] for r in got.collect()} == want


def test_global_rank_equals_window_rank(spark):
    data, df = make(spark)
    got = {r["id"]: r["r"] for r in rank_split(df, [], "v", "r").collect()}
    want = {i: 1 + sum(1 for _, _, w in data if w > v) for i, _, v in data}
    assert got == want


def test_rank_with_null_keys_keeps_rows(spark):
    df = spark.createDataFrame(
        [(1, None, 2.0), (2, None, 3.0), (3, "a", 1.0)], "id int, k string, v double"
    )
    df = df.unionByName(spark.createDataFrame([(4, None, None)], df.schema))
    for hot_rows in (0, 100):
        got = rank_split(df, ["k"], "v", "r", hot_rows=hot_rows).select("id", "r")
        assert rows(got) == [(1, 2), (2, 1), (3, 1), (4, None)]


def test_counts_on_empty_input(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert counts_before(df, ["k"], "v").count() == 0


def test_exact_quantile(spark):
    for values in ([5.0], [1.0, 2.0], [3.0, 1.0, 2.0], [1.0] * 10 + [9.0] * 3, list(map(float, range(101)))):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        ordered = sorted(values)
        want = ordered[-(-len(ordered) // 2) - 1]
        assert exact_quantile(df, "v", 0.5) == want
        assert exact_quantile(df, "v", 0.5, buckets=4, small=1) == want


def test_exact_quantile_of_whole_numbers_and_ends(spark):
    data = [(n * n % 997,) for n in range(5000)]
    df = spark.createDataFrame(data, "v bigint")
    ordered = sorted(v for v, in data)
    for q in (0.0, 0.1, 0.9, 1.0):
        want = ordered[max(-(-int(5000 * q * 1000) // 1000), 1) - 1]
        assert exact_quantile(df, "v", q, buckets=8, small=10) == want
    assert exact_quantile(df.limit(0), "v", 0.5) is None


NAN = float("nan")
TYPED = {
    "string": [f"w{n * n % 37}" for n in range(300)] + ["", "ü", "a'b\\"],
    "date": [dt.date(1950, 1, 1) + dt.timedelta(days=n * 211 % 97) for n in range(300)],
    "timestamp": [dt.datetime(1960, 3, 1) + dt.timedelta(microseconds=n * 7919 % 101) for n in range(300)],
    "timestamp_ntz": [dt.datetime(2040, 3, 1) + dt.timedelta(microseconds=n * 7919 % 101) for n in range(300)],
    "double": [float(n % 41) for n in range(300)] + [NAN] * 9 + [float("inf"), -float("inf"), 0.0, -0.0],
    "float": [n % 43 / 10 for n in range(300)] + [NAN],
    "decimal(20,4)": [Decimal(n * 37 % 89) / 8 for n in range(300)],
    "boolean": [n % 3 == 0 for n in range(300)],
    "binary": [bytes([n % 7, n % 251]) for n in range(300)],
}


def exact(v):
    return str(v) if isinstance(v, float) and v != v else v


@pytest.mark.parametrize("kind", TYPED)
def test_any_type_that_orders(spark, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*TYPED[kind], None])], f"i int, v {kind}").repartition(5).persist()
    ordered = [exact(r[0]) for r in df.where("v IS NOT NULL").orderBy("v").select("v").collect()]
    for q, small in ((0.3, 5), (0.99, 5), (0.5, 10**6)):
        want = ordered[max(math.ceil(len(ordered) * q), 1) - 1]
        assert exact(exact_quantile(df, "v", q, buckets=8, small=small)) == want
    window = W.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("v"))
    want = df.withColumn("r", F.when(F.col("v").isNotNull(), F.rank().over(window))).select("i", "r")
    assert rows(rank_split(df, [], "v", "r").select("i", "r")) == rows(want)
    by = df.withColumn("k", F.lit("x"))
    assert rows(rank_split(by, ["k"], "v", "r", hot_rows=0).select("i", "r")) == rows(want)


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), F.lit("x").alias("a")).repartition(7)
    assert rows(row_numbers(df, [F.desc("id")], "place")) == rows(df.select("id", "a", (999 - F.col("id")).alias("place")))
    assert row_numbers(df.limit(0), ["id"], "place").count() == 0


def test_first_and_top_per_key(spark, partitions):
    data, df = make(spark, 600)
    want = {}
    for i, k, v in sorted(data, key=lambda r: (r[2], r[0])):
        want.setdefault(k, i)
    for _ in partitions():
        got = first_per_key(df.repartition(6), ["k"], [F.asc("v"), F.asc("id")])
        assert {r["k"]: r["id"] for r in got.collect()} == want
    top = top_per_key(df, ["k"], [F.desc("v"), F.asc("id")], 3)
    hot = [r for r in top.collect() if r["k"] == "hot"]
    assert sorted(r["rank"] for r in hot) == [1, 2, 3]


def test_first_per_key_limits_groups_before_the_shuffle(spark):
    _, df = make(spark, 100)
    plan = first_per_key(df, ["k"], [F.asc("id")])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    assert rows(null_safe_join(a, b, ["k"], "inner")) == [(None, 1, 10)]
