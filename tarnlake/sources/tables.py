"""Layered Parquet tables: writing, swapping, compaction and registration."""

from __future__ import annotations

import hashlib
import math
import re
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarnlake.config import LAYERS, Source, layer_of
from tarnlake.sources.manifest import Entry, Manifest, ManifestFolder, Part
from tarnlake.sources.readers import read_source, source_stats

TARGET_FILE_BYTES = 256 * 1024 * 1024


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move_path(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, _fs(spark, new)[1]):
        raise OSError(f"cannot move {old} to {new}")


def child_folders(spark: SparkSession, path: str, hidden: bool = False) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in found if hidden or "__" not in n)


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    compression: str = "zstd",
    sort: Sequence[str] = (),
) -> None:
    """Write Parquet. With partition columns the rows are rebalanced on them first.

    The rebalance hint lets adaptive execution merge small partition values and split
    large ones, so neither many tiny files nor one huge task comes out of it.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort:
        df = df.sortWithinPartitions(*partition_by, *sort)
    writer = df.write.mode(mode).option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def swap_in(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the complete folder ``fresh`` in the place of ``path``."""
    old = f"{path}__old_{uuid.uuid4().hex[:8]}"
    had = path_exists(spark, path)
    if had:
        move_path(spark, path, old)
    move_path(spark, fresh, path)
    if had:
        remove_path(spark, old)
    # Cached file listings of the old folder would point at removed files.
    spark.catalog.refreshByPath(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table, also one that ``df`` itself reads: write aside, then swap folders."""
    fresh = f"{path}__new_{uuid.uuid4().hex[:8]}"
    write_table(df, fresh, partition_by=partition_by)
    swap_in(df.sparkSession, fresh, path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes with the names, sizes or times of a folder's files."""
    fs, p = _fs(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        s = files.next()
        found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def checksum(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash over all columns."""
    row = df.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("h"),
    ).first()
    return row["n"], row["h"]


@dataclass(frozen=True)
class Compaction:
    table: str
    files_before: int
    files_after: int
    bytes_before: int
    bytes_after: int
    duration_s: float

    @property
    def savings_pct(self) -> float:
        if self.bytes_before == 0:
            return 0.0
        return (1 - self.bytes_after / self.bytes_before) * 100


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Columns that a table's folders are named after, outermost first."""
    names = []
    while inner := [n for n in child_folders(spark, path) if "=" in n]:
        names.append(inner[0].split("=", 1)[0])
        path = f"{path}/{inner[0]}"
    return names


def compact(
    spark: SparkSession,
    path: str,
    target_bytes: int = TARGET_FILE_BYTES,
    partition_by: Sequence[str] = (),
) -> Compaction | None:
    """Rewrite a table's small files into files of about ``target_bytes``; None below two files.

    A partitioned table keeps its layout unless another is given.

    Unpartitioned tables are repacked without a shuffle: the scan itself groups whole
    files into read partitions of the target size, and each becomes one output file.
    """
    started = time.time()
    partition_by = list(partition_by) or partition_columns(spark, path)
    before = source_stats(spark.read.parquet(path)).first()
    if before["files"] < 2:
        return None
    wanted = max(1, math.ceil(before["bytes"] / target_bytes))
    # Settings of a session of its own, so the caller's stay as they are.
    packer = spark.newSession()
    packer.conf.set("spark.sql.files.maxPartitionBytes", math.ceil(before["bytes"] / wanted) + 1)
    packer.conf.set("spark.sql.files.openCostInBytes", 0)
    packer.conf.set("spark.sql.files.minPartitionNum", wanted)
    fresh = f"{path}__new_{uuid.uuid4().hex[:8]}"
    write_table(packer.read.parquet(path), fresh, partition_by=partition_by)
    if checksum(spark.read.parquet(path)) != checksum(spark.read.parquet(fresh)):
        remove_path(spark, fresh)
        raise RuntimeError(f"compaction of {path} changed its content; the table is untouched")
    swap_in(spark, fresh, path)
    after = source_stats(spark.read.parquet(path)).first()
    return Compaction(
        path, before["files"], after["files"], before["bytes"], after["bytes"],
        time.time() - started,
    )


def compact_all(spark: SparkSession, paths: Iterable[str], **options) -> list[Compaction]:
    results = (compact(spark, p, **options) for p in paths)
    return [r for r in results if r is not None]


def retain_since(df: DataFrame, ts: str, cutoff) -> DataFrame:
    """Rows at or after the cutoff; rows without a timestamp are kept."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= cutoff))


def table_name(raw: str) -> str:
    """Lower-case name with everything but letters, digits and underscores replaced."""
    return re.sub(r"[^a-z0-9_]", "_", raw.lower())


#: Column that deals a table's rows to its buckets while they are written.
BUCKET = "__bucket"
#: Rows a bucket starts with at most.
BUCKET_ROWS = 1_000_000
STATE = "_state"


class Batch:
    """Changes of one batch. All become visible together when it is committed, or none does.

    Every write goes to a folder of the batch's own; only the manifest says which folders make
    up a table. What a failed batch wrote is never read, and ``Lakehouse.vacuum`` removes it.
    """

    def __init__(self, lake: Lakehouse):
        self.lake, self.spark, self.base = lake, lake.spark, lake.manifest()
        self.tables, self.marks = dict(self.base.tables), dict(self.base.marks)
        self.number = self.base.version + 1
        self.id = f"b{self.number:08d}-{uuid.uuid4().hex[:8]}"
        self._folders = 0

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def commit(self) -> Manifest:
        done = Manifest(self.number, self.tables, self.marks)
        self.lake.switch(done)
        return done

    def entry(self, key: str) -> Entry | None:
        return self.tables.get(key)

    def _folder(self, key: str) -> str:
        self._folders += 1
        return f"{key}/{self.id}-{self._folders}"

    def stage(self, df: DataFrame, key: str, partition_by: Sequence[str] = (), kind: str = "") -> Part:
        """Write rows for a table without showing them yet."""
        folder = self._folder(key)
        counted = Observation(f"rows_{uuid.uuid4().hex}")
        write_table(df.observe(counted, F.count(F.lit(1)).alias("n")), f"{self.lake.root}/{folder}", partition_by=partition_by)
        return Part(folder, counted.get["n"], kind=kind)

    def stage_buckets(self, df: DataFrame, key: str, bucket: Column, sort: Sequence[str] = ()) -> list[Part]:
        """Write rows as one part per bucket, files sorted by ``sort``."""
        folder = self._folder(key)
        path = f"{self.lake.root}/{folder}"
        write_table(df.withColumn(BUCKET, bucket), path, partition_by=[BUCKET], sort=sort)
        if not child_folders(self.spark, path, hidden=True):
            return []
        counts = self.spark.read.parquet(path).groupBy(BUCKET).count().collect()
        return [Part(f"{folder}/{BUCKET}={r[0]}", r[1], r[0]) for r in sorted(counts)]

    def read_part(self, *parts: Part) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.lake.root}/{p.path}" for p in parts])

    def put(self, table: str, parts: Iterable[Part], **fields) -> None:
        """Make ``parts`` the whole table."""
        held = self.tables.get(table, Entry())
        self.tables[table] = replace(held, parts=tuple(parts), **fields)

    def add(self, table: str, *parts: Part) -> None:
        """Add parts to a table; an empty one only where the table has no other."""
        held = self.tables.get(table, Entry())
        self.put(table, (*held.parts, *(p for p in parts if p.rows or not held.parts)))

    def drop(self, key: str) -> None:
        self.tables.pop(key, None)


def bucket_of(by: Sequence[str], n: int) -> Column:
    # Values of different numeric types but equal text meet in one bucket.
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in by]), F.lit(n)).cast("int")


class Lakehouse:
    """Tables ``{bronze,silver,gold}/name`` below a root, each made up of the parts its manifest lists."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._versions = ManifestFolder(spark, f"{self.root}/_manifest")

    def manifest(self, version: int | None = None) -> Manifest:
        return self._versions.read(version)

    def switch(self, manifest: Manifest) -> None:
        self._versions.switch(manifest)

    def batch(self) -> Batch:
        return Batch(self)

    def key(self, name: str, layer: str | None = None) -> str:
        return f"{layer if layer == STATE else layer_of(name, layer)}/{name}"

    def write(self, df: DataFrame, name: str, layer: str | None = None, partition_by: Sequence[str] = ()) -> str:
        """Replace a table, also one that ``df`` itself reads; returns the folder of its only part."""
        with self.batch() as batch:
            part = batch.stage(df, self.key(name, layer), partition_by)
            batch.put(self.key(name, layer), [part], buckets=0, key=())
        return f"{self.root}/{part.path}"

    def append(self, df: DataFrame, name: str, layer: str | None = None, partition_by: Sequence[str] = ()) -> str:
        with self.batch() as batch:
            part = batch.stage(df, self.key(name, layer), partition_by)
            batch.add(self.key(name, layer), part)
        return f"{self.root}/{part.path}"

    def tables(self) -> list[tuple[str, str]]:
        """``(layer, name)`` of every table."""
        keys = (k.split("/", 1) for k in self.manifest().tables)
        return sorted(((layer, name) for layer, name in keys if layer != STATE), key=lambda t: (LAYERS.index(t[0]), t[1]))

    def exists(self, name: str, layer: str | None = None) -> bool:
        return self.key(name, layer) in self.manifest().tables

    def entry(self, name: str, layer: str | None = None) -> Entry:
        found = self.manifest().tables.get(self.key(name, layer))
        if found is None:
            raise LookupError(f"no table {self.key(name, layer)}")
        return found

    def parts(self, name: str, layer: str | None = None) -> list[str]:
        return [f"{self.root}/{p.path}" for p in self.entry(name, layer).parts]

    def read(self, name: str, layer: str | None = None, version: int | None = None) -> DataFrame:
        """A table as it stands, or as it stood after an earlier batch (until ``vacuum``)."""
        held = self.manifest(version).tables.get(self.key(name, layer))
        if held is None:
            raise LookupError(f"no table {self.key(name, layer)}")
        return self.spark.read.parquet(*[f"{self.root}/{p.path}" for p in held.parts])

    def find(self, name: str) -> DataFrame | None:
        """A table by name in whichever layer holds it."""
        for layer, held in self.tables():
            if held == name:
                return self.read(name, layer)
        return None

    def compact(self, name: str, layer: str | None = None) -> int:
        """Fold a table's parts into one (bucketed tables: one per bucket and kind); returns the parts before."""
        key = self.key(name, layer)
        with self.batch() as batch:
            held = batch.entry(key)
            groups: dict[tuple, list[Part]] = {}
            for p in held.parts:
                groups.setdefault((p.bucket, p.kind), []).append(p)
            parts = []
            for (bucket, kind), own in groups.items():
                if len(own) > 1:
                    own = [replace(batch.stage(batch.read_part(*own), key, kind=kind), bucket=bucket)]
                parts += own
            if sum(p.rows for p in parts) != held.rows:
                raise RuntimeError(f"compaction of {key} changed its rows; the table is untouched")
            batch.put(key, parts)
        return len(held.parts)

    def vacuum(self, keep: int = 1) -> int:
        """Remove the folders that none of the last ``keep`` versions lists, and older versions; returns the folders.

        Not to be run while a batch is under way.
        """
        versions = self._versions.versions()
        held = [self.manifest(v) for v in versions[-keep:]]
        used = {p.path.split("/")[2] for m in held for e in m.tables.values() for p in e.parts}
        gone = 0
        for layer in (*LAYERS, STATE):
            for name in child_folders(self.spark, f"{self.root}/{layer}"):
                for folder in child_folders(self.spark, f"{self.root}/{layer}/{name}"):
                    if folder not in used:
                        remove_path(self.spark, f"{self.root}/{layer}/{name}/{folder}")
                        gone += 1
        for v in versions[:-keep]:
            self._versions.forget(v)
        return gone

    def register_views(self) -> list[str]:
        """Temp views for every table under ``name`` and ``layer_name``."""
        names = []
        for layer, name in self.tables():
            df = self.read(name, layer)
            for view in (name, f"{layer}_{name}"):
                df.createOrReplaceTempView(view)
                names.append(view)
        return names

    def register_file(self, raw_name: str, path: str, layer: str = "bronze", **options) -> str:
        """Take a Parquet, CSV, JSON or NDJSON file into a layer as Parquet; returns the name."""
        suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if suffix not in ("parquet", "csv", "json", "ndjson"):
            raise ValueError(f"cannot register .{suffix} files")
        if suffix == "json":
            options.setdefault("multiLine", "true")
        name = table_name(raw_name)
        df = read_source(self.spark, Source(name, suffix, path=path, options=options))
        self.write(df, name, layer)
        return name
