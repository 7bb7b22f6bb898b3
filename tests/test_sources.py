import pytest
from pyspark.sql import types as T

from tarnlake.config import Source
from tarnlake.session import scratch_path
from tarnlake.sources.readers import (
    jdbc_options,
    read_source,
    s3a,
    source_schema,
    source_stats,
    split_bad_rows,
)
from tarnlake.sources.tables import (
    Lakehouse,
    checksum,
    compact,
    compact_all,
    replace_table,
    retain_since,
    table_name,
    write_table,
)
from tarnlake.streaming.events import kafka_options

from .conftest import rows


def test_delimited_with_null_text_and_quotes(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text('id\tname\n1\t\\N\n2\t"a\tb"\n')
    source = Source("t", "http", path=str(path), options={"sep": "\t", "null_str": "\\N", "all_strings": True})
    assert rows(read_source(spark, source)) == [("1", None), ("2", "a\tb")]


def test_bad_rows_go_to_quarantine(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("1,2.5\nx,3\n4,\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    good, bad = split_bad_rows(spark, str(path), schema)
    assert rows(good) == [(1, 2.5), (4, None)]
    assert rows(bad) == [("x,3",)]


def test_ignore_errors_drops_bad_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\nx,3\n")
    source = Source("t", "csv", path=str(path), options={"ignore_errors": True, "schema": "a INT, b INT"})
    assert rows(read_source(spark, source)) == [(1, 2)]


def test_records_under_a_key_and_filter(spark, tmp_path):
    path = tmp_path / "page.json"
    path.write_text('{"page": 1, "results": [{"id": 1, "kind": "a"}, {"id": 2, "kind": "b"}]}')
    options = {"records_key": "results", "filter": {"kind": "b"}}
    assert rows(read_source(spark, Source("p", "rest", path=str(path), options=options))) == [(2, "b")]


def test_unknown_type_and_missing_path(spark):
    with pytest.raises(ValueError, match="no batch reader"):
        read_source(spark, Source("x", "carrier-pigeon", path="x"))
    with pytest.raises(ValueError, match="path"):
        read_source(spark, Source("x", "csv"))


def test_jdbc_options():
    source = Source(
        "x", "postgres", query="SELECT 1",
        connection={"host": "h", "port": 5432, "database": "d", "user": "u", "password": "p"},
        options={"partition_column": "id", "lower_bound": 0, "upper_bound": 9, "num_partitions": 3},
    )
    got = jdbc_options(source)
    assert got["url"] == "jdbc:postgresql://h:5432/d"
    assert got["dbtable"] == "(SELECT 1) AS q" and "query" not in got
    assert got["numPartitions"] == "3" and got["user"] == "u"
    assert jdbc_options(Source("y", "duckdb", path="f.db", connection={"table": "t"}))["url"] == "jdbc:duckdb:f.db"
    assert jdbc_options(Source("z", "mysql", url="jdbc:mysql://h/d", query="q"))["query"] == "q"


def test_kafka_options():
    source = Source("k", "kafka", connection={"broker": "b:9092", "topic": "t", "group_id": "g",
                                              "auto_offset_reset": "earliest", "format": "json"})
    assert kafka_options(source) == {
        "kafka.bootstrap.servers": "b:9092", "subscribe": "t", "startingOffsets": "earliest",
        "kafka.group.id": "g",
    }


def test_s3_paths():
    assert s3a("s3://bucket/x") == "s3a://bucket/x" and s3a("/x") == "/x"


def test_model_table(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "m"))
    assert read_source(spark, Source("m", "dbt", path=str(tmp_path / "m"))).count() == 3


def test_stats_and_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).repartition(3).write.parquet(path)
    stats = source_stats(spark.read.parquet(path)).first()
    assert (stats["row_count"], stats["column_count"], stats["files"]) == (10, 1, 3)
    assert rows(source_schema(spark.read.parquet(path))) == [(0, "id", "bigint", True)]


def test_replace_a_table_that_is_being_read(spark):
    path = scratch_path(spark, "t")
    write_table(spark.range(5), path)
    replace_table(spark.read.parquet(path).filter("id > 2"), path)
    assert rows(spark.read.parquet(path)) == [(3,), (4,)]


def test_compaction(spark):
    path = scratch_path(spark, "t")
    spark.range(1000).repartition(12).write.parquet(path)
    before = checksum(spark.read.parquet(path))
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    result = compact(spark, path)
    assert result.files_before == 12 and result.files_after == 1
    assert checksum(spark.read.parquet(path)) == before
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == conf
    assert compact(spark, path) is None
    assert compact_all(spark, [path]) == []


def test_compaction_keeps_several_files_when_large(spark):
    path = scratch_path(spark, "t")
    spark.range(50_000).selectExpr("id", "uuid() AS u").repartition(20).write.parquet(path)
    total = source_stats(spark.read.parquet(path)).first()["bytes"]
    result = compact(spark, path, target_bytes=total // 3 + 1)
    assert 2 <= result.files_after <= 6


def test_partitioned_write(spark):
    path = scratch_path(spark, "t")
    write_table(spark.range(100).selectExpr("id", "id % 4 AS p"), path, partition_by=["p"])
    assert spark.read.parquet(path).filter("p = 1").count() == 25
    result = compact(spark, path, partition_by=["p"])
    assert result is None or result.files_after >= 4


def test_retention_keeps_rows_without_time(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-01'), (2, DATE'2024-02-01'), (3, NULL) AS t(n, d)")
    assert rows(retain_since(df, "d", "2024-01-15").select("n")) == [(2,), (3,)]


def test_register_files_and_views(spark, tmp_path):
    path = tmp_path / "Some-File.json"
    path.write_text('[{"a": 1},\n {"a": 2}]')
    lake = Lakehouse(spark, scratch_path(spark, "lake"))
    name = lake.register_file("My Table!", str(path), "silver")
    assert name == table_name("My Table!") == "my_table_"
    lake.register_views()
    assert spark.sql("SELECT sum(a) AS s FROM silver_my_table_").first()["s"] == 3
    assert spark.table("my_table_").count() == 2
    assert lake.tables() == [("silver", "my_table_")]
    with pytest.raises(ValueError):
        lake.register_file("x", "x.xlsx")
