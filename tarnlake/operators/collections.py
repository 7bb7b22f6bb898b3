"""Vector collections kept in a lakehouse: replaced whole or by key, of one dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.upserts import merge_scd1, put_keyed
from tarnlake.sources.tables import BUCKET_ROWS, STATE, Batch, Lakehouse


class Collection:
    """Vectors ``id, vector`` by key, with their count and dimension kept beside them.

    Rows without an id or a vector are left out. A key stands once; of several rows of one key in a batch the
    one with the greatest vector stays. A batch with a vector of another dimension is refused and changes nothing.
    """

    def __init__(self, lake: Lakehouse, name: str, bucket_rows: int = BUCKET_ROWS):
        self.lake, self.name, self.bucket_rows = lake, name, bucket_rows
        self.table, self._mark = lake.key(f"vectors_{name}", STATE), f"dimension of vectors_{name}"

    def exists(self) -> bool:
        return self.table in self.lake.manifest().tables

    def status(self) -> dict:
        """Whether it is built, vectors, dimension: from the manifest alone."""
        manifest = self.lake.manifest()
        held = manifest.tables.get(self.table)
        dimension = int(manifest.marks.get(self._mark, 0))
        return {"collection": self.name, "is_built": held is not None, "vectors": held.rows if held else 0, "dimensions": dimension}

    def read(self) -> DataFrame:
        return self.lake.read(f"vectors_{self.name}", STATE).select("id", "vector")

    def _checked(self, batch: Batch, vectors: DataFrame, id_col: str, vector: str, dimension: int) -> DataFrame:
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("vector"))
        rows = rows.where("id IS NOT NULL AND vector IS NOT NULL")
        # Every dimension in use is a row of this aggregate; two are enough to refuse.
        sizes = [r[0] for r in rows.groupBy(F.size("vector")).count().orderBy(F.desc("count")).limit(2).collect()]
        wrong = [n for n in sizes if n != (dimension or sizes[0])]
        if wrong or 0 in sizes:
            raise ValueError(f"{self.name} holds vectors of {dimension or sizes[0]} components, not of {(wrong or sizes)[0]}")
        if sizes:
            batch.marks[self._mark] = str(sizes[0])
        return rows.withColumn("written_in", F.lit(batch.number))

    def replace(self, vectors: DataFrame, id_col: str, vector: str) -> dict:
        """Make these vectors the whole collection; its dimension may change."""
        with self.lake.batch() as batch:
            batch.marks.pop(self._mark, None)
            rows = self._checked(batch, vectors, id_col, vector, 0)
            once = rows.groupBy("id").agg(F.max("vector").alias("vector"), F.max("written_in").alias("written_in"))
            put_keyed(batch, self.table, once, ["id"], self.bucket_rows)
            if not batch.entry(self.table).parts:
                batch.put(self.table, [batch.stage(once, self.table)], buckets=1, key=("id",))
        return self.status()

    def put(self, vectors: DataFrame, id_col: str, vector: str) -> dict:
        """Add vectors; those of keys that are held are replaced. Only the buckets of their keys are rewritten."""
        if not self.status()["vectors"]:
            return self.replace(vectors, id_col, vector)
        with self.lake.batch() as batch:
            rows = self._checked(batch, vectors, id_col, vector, int(batch.marks[self._mark]))
            once = rows.groupBy("id").agg(F.max("vector").alias("vector"), F.max("written_in").alias("written_in"))
            merge_scd1(batch, self.table, once, ["id"], "written_in", self.bucket_rows)
        return self.status()
