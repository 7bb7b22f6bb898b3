"""Stored vector collections: replaced whole or by key, one dimension, only touched buckets rewritten."""

import pytest

from tarnlake.operators.collections import Collection
from tarnlake.session import scratch_path
from tarnlake.sources.tables import Lakehouse

from .conftest import rows


def frame(spark, *data):
    return spark.createDataFrame(data, "k bigint, v array<float>")


def test_replace_put_and_refuse(spark):
    lake = Lakehouse(spark, scratch_path(spark, "lake"))
    held = Collection(lake, "c", bucket_rows=2)
    assert held.status() == {"collection": "c", "is_built": False, "vectors": 0, "dimensions": 0}
    first = frame(spark, *[(i, [float(i), 0.0]) for i in range(8)], (None, [1.0, 1.0]), (9, None), (7, [9.0, 9.0]))
    assert held.replace(first, "k", "v") == {"collection": "c", "is_built": True, "vectors": 8, "dimensions": 2}
    before = set(lake.parts("vectors_c", "_state"))
    assert held.put(frame(spark, (3, [5.0, 5.0]), (3, [4.0, 4.0])), "k", "v")["vectors"] == 8
    assert len(before & set(lake.parts("vectors_c", "_state"))) == len(before) - 1
    assert held.put(frame(spark, (20, [1.0, 2.0])), "k", "v")["vectors"] == 9
    got = dict(rows(held.read()))
    assert got[3] == [5.0, 5.0] and got[7] == [9.0, 9.0] and got[20] == [1.0, 2.0] and got[0] == [0.0, 0.0]
    version = lake.manifest().version
    for wrong in ([(1, [1.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], [(1, [])]):
        with pytest.raises(ValueError, match="components"):
            held.put(frame(spark, *wrong), "k", "v")
    assert lake.manifest().version == version and held.read().count() == 9
    assert held.replace(frame(spark, (1, [1.0, 2.0, 3.0])), "k", "v")["dimensions"] == 3
    assert held.replace(frame(spark), "k", "v") == {"collection": "c", "is_built": True, "vectors": 0, "dimensions": 0}
    assert held.read().count() == 0
    assert held.put(frame(spark, (1, [1.0])), "k", "v")["vectors"] == 1
