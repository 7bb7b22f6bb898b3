"""What a lakehouse's tables consist of: one small file per batch, switched in one step."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Part:
    """One folder of Parquet files below the root, written by one batch and never changed."""

    path: str
    rows: int
    bucket: int | None = None
    kind: str = ""


@dataclass(frozen=True)
class Entry:
    """A table: its parts, its buckets and their key if it has any, and the last lineage event that wrote it."""

    parts: tuple[Part, ...] = ()
    buckets: int = 0
    key: tuple[str, ...] = ()
    event: str | None = None

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)


@dataclass(frozen=True)
class Manifest:
    """All tables (``layer/name``) and how far every source was read, after one batch."""

    version: int = 0
    tables: Mapping[str, Entry] = field(default_factory=dict)
    marks: Mapping[str, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        tables = {
            name: Entry(tuple(Part(**p) for p in e["parts"]), e["buckets"], tuple(e["key"]), e["event"])
            for name, e in raw["tables"].items()
        }
        return cls(raw["version"], tables, raw["marks"])


class ManifestFolder:
    """Versions of a manifest as files ``000…7.json``; the highest number counts.

    A version is written aside and renamed, so a reader sees all of a batch or nothing. One
    writer at a time: a second one that started from the same version is refused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path(self.path)))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _file(self, version: int) -> str:
        return f"{self.path}/{version:012d}.json"

    def read(self, version: int | None = None) -> Manifest:
        """A version, the latest by default; empty where nothing was written yet."""
        if version is None:
            version = max(self.versions(), default=0)
            if not version:
                return Manifest()
        fs, path = self._fs()
        stream = fs.open(path(self._file(version)))
        try:
            return Manifest.from_json(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def switch(self, manifest: Manifest) -> None:
        """Make ``manifest`` the latest version."""
        fs, path = self._fs()
        final, aside = path(self._file(manifest.version)), path(f"{self.path}/.{manifest.version:012d}.tmp")
        if fs.exists(final) or max(self.versions(), default=0) >= manifest.version:
            raise RuntimeError(f"version {manifest.version} was written by another batch; this one left no trace")
        stream = fs.create(aside, True)
        stream.write(bytearray(manifest.to_json(), "utf-8"))
        stream.close()
        if not fs.rename(aside, final):
            raise OSError(f"cannot write {final}")

    def forget(self, version: int) -> None:
        fs, path = self._fs()
        fs.delete(path(self._file(version)), False)
