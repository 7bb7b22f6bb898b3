import datetime as dt

from tarnlake.operators.merge import scd1_merge, scd2_history, scd2_merge

from tarnlake.session import reliable_checkpoint

from .conftest import rows

LOG = "k int, v string, ts timestamp"


def day(n, month=1):
    return dt.datetime(2024, month, n)


def history(spark, data, **options):
    return scd2_history(spark.createDataFrame(data, LOG), ["k"], "ts", ["v"], **options)


def plain(df):
    return rows(df.select("k", "v", "effective_from", "effective_to", "is_current"))


def test_unchanged_rows_make_no_version(spark):
    got = history(
        spark,
        [(1, "a", day(1)), (1, "a", day(5)), (1, "b", day(3, 2)), (1, "b", day(4, 3)), (1, "a", day(1, 5))],
    )
    assert plain(got) == sorted(
        [
            (1, "a", day(1), day(3, 2), False),
            (1, "b", day(3, 2), day(1, 5), False),
            (1, "a", day(1, 5), None, True),
        ],
        key=repr,
    )


def test_bucket_size_does_not_matter(spark):
    data = [(k, "xyz"[(n * k) % 3], day(1 + n % 28, 1 + n % 12)) for k in range(4) for n in range(60)]
    results = [plain(history(spark, data))]
    results += [plain(history(spark, data, hot_rows=n)) for n in (0, 9)]
    assert all(r == results[0] for r in results)



def test_versions_may_be_numbers(spark):
    data = [(1, v, i) for i, v in enumerate("aabbca" * 5)] + [(2, "x", 7)]
    log = spark.createDataFrame(data, "k int, v string, ts bigint")
    got = [rows(scd2_history(log, ["k"], "ts", ["v"], hot_rows=n)) for n in (0, 10**6)]
    assert got[0] == got[1]
    assert [r for r in got[0] if r[0] == 2] == [(2, "x", 7, None, True)]


def test_null_states_are_versions_too(spark):
    data = [(1, None, day(1)), (1, None, day(2)), (1, "a", day(3, 4))]
    for hot_rows in (0, 100):
        assert history(spark, data, hot_rows=hot_rows).count() == 2


def test_merge_applies_rejects_and_repeats(spark):
    base = history(spark, [(1, "a", day(1)), (2, "p", day(1)), (3, "z", day(1))])
    batch = spark.createDataFrame(
        [
            (1, "b", day(1, 2)), (1, "c", day(1, 3)),  # two changes of one key
            (2, "p", day(9)),  # no change
            (3, "old", dt.datetime(2023, 5, 1)),  # older than the open version
            (4, "n", day(2)),  # new key
        ],
        LOG,
    )
    base = reliable_checkpoint(base)
    merged, rejected = scd2_merge(base, batch, ["k"], "ts", ["v"])
    want = sorted(
        [
            (1, "a", day(1), day(1, 2), False),
            (1, "b", day(1, 2), day(1, 3), False),
            (1, "c", day(1, 3), None, True),
            (2, "p", day(1), None, True),
            (3, "z", day(1), None, True),
            (4, "n", day(2), None, True),
        ],
        key=repr,
    )
    merged = reliable_checkpoint(merged)
    assert plain(merged) == want
    assert [r["v"] for r in rejected.collect()] == ["old"]
    again, _ = scd2_merge(merged, batch, ["k"], "ts", ["v"])
    assert plain(again) == want


def test_scd1_takes_newest_and_keeps_others(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "c", day(1)), (2, "d", day(2)), (3, "e", day(1))], LOG)
    assert rows(scd1_merge(target, changes, ["k"], "ts")) == [(1, "a"), (2, "d"), (3, "e")]


def test_scd1_ignores_changes_older_than_the_held_row(spark):
    target = spark.createDataFrame([(1, "new", day(5))], LOG)
    changes = spark.createDataFrame([(1, "late", day(2))], LOG)
    assert rows(scd1_merge(target, changes, ["k"], "ts")) == [(1, "new", day(5))]
